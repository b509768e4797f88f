"""Near duplicates by SimHash: fingerprints as points of segment bit counts, met on a grid.

*Fingerprint.* A-Z count as a-z. A text's shingles are its runs of three words joined by one space, repeats included; a shorter text
is one shingle, one without words has none and fingerprint zero. Bit b is set if it is set in over half of the shingles' XXH64
(UTF-8, seed 42).

*Embedding.* The 64 bits are cut into segments of two, and each segment is replaced by its number of set bits. The Manhattan
distance of two such points never exceeds the number of bits in which the fingerprints differ.

*Grid join.* The 32 coordinates are dealt into ``radius // 2 + 1`` parts. Points at most ``radius`` apart are at most 1 apart in one part at least,
so a point owns the cell of each part's coordinates and visits the cells with one coordinate more by one: two points that are
1 apart in a part meet in the cell that one of them owns. Cells without an owner or with one point are left out by counts; the others
are cut into tiles of at most ``TILE`` owners and ``TILE`` points, so a hot cell becomes many tasks.

*Verify.* Pairs of a tile that the Manhattan distance of all coordinates leaves open are compared bit by bit. A tile returns each
linked fingerprint once, with the smallest one of the tile it is connected to, so nothing quadratic leaves a task.

Only distinct fingerprints enter the grid, so copies cost nothing, and all their ids meet again by the fingerprint.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero and link like any other. A repeated id is one
document whose rows count as linked. Rows whose id is null come back with their fingerprint and a null component, and link nothing.
Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import components, stored
from tablewright.llm.words import _LOWER, spans, text_slices

SEED = 42
TILE = 1 << 14
PAIRS = 1 << 21  # pairs compared at a time
CHUNK = 1 << 16  # shingles hashed at a time
_ODD = np.uint64(0x5555555555555555)
_LANES = np.uint64(0x0101010101010101)


def _shingles(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a slice joined by single spaces; first byte, end and text number of every shingle in it."""
    data = _LOWER[data]
    first, last = spans(data)
    text = np.searchsorted(starts, first, "right") - 1
    keep = np.zeros(len(data) + 1, dtype=np.int8)
    keep[first] += 1
    keep[last] -= 1
    inside = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    inside[last] = True  # the gap after a word, which every text has
    data[last] = 32
    ends = np.cumsum(last - first + 1)
    own_first, own_last = ends - (last - first + 1), ends - 1
    count = np.bincount(text, minlength=len(starts) - 1)
    final = np.cumsum(count) - 1  # last word of every text
    word = np.arange(len(text))
    to = np.minimum(word + n - 1, final[text])
    whole = (to - word == n - 1) | ((count[text] < n) & (word == final[text] - count[text] + 1))
    return data[inside].tobytes(), own_first[whole], own_last[to[whole]], text[whole]


def _majorities(hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> None:
    """Add to ``counts`` (texts, 64) how often each bit is set among each text's hashes; ``owner`` rises."""
    new = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    place = np.arange(len(owner)) - np.repeat(new, np.diff(np.append(new, len(owner))))
    cuts = np.flatnonzero(place % 255 == 0)  # a byte counts to 255
    runs = np.flatnonzero(np.append(True, owner[cuts][1:] != owner[cuts][:-1]))
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, cuts).view(np.uint8).reshape(-1, 8)
        counts[owner[cuts][runs], bit::8] += np.add.reduceat(lanes.astype(np.int64), runs, axis=0)


def fingerprints(data: np.ndarray, starts: np.ndarray, n: int = 3) -> np.ndarray:
    """Fingerprint of every text of a slice."""
    raw, first, last, owner = _shingles(data, starts, n)
    texts, one = len(starts) - 1, xxhash.xxh64_intdigest
    counts = np.zeros((texts, 64), dtype=np.int64)
    for at in range(0, len(first), CHUNK):
        a, b = first[at : at + CHUNK], last[at : at + CHUNK]
        hashes = np.fromiter((one(raw[x:y], SEED) for x, y in zip(a.tolist(), b.tolist())), dtype=np.uint64, count=len(a))
        _majorities(hashes, owner[at : at + CHUNK], counts)
    total = np.bincount(owner, minlength=texts)
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprint_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, starts in text_slices(batch.column(1)):
                found = fingerprints(data, starts, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(found)), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return run


def segment_counts(prints: np.ndarray) -> np.ndarray:
    """Set bits of each two-bit segment, in the two bits of the segment."""
    return prints - ((prints >> np.uint64(1)) & _ODD)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of points packed by ``segment_counts``."""
    x = a ^ b  # counts 0 and 1, or 1 and 2, differ by one; 0 and 2 by two
    low, high = x & _ODD, (x >> np.uint64(1)) & _ODD
    return np.bitwise_count(low | high) + np.bitwise_count(high & ~low)


def grid(prints: np.ndarray, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(cell, fingerprint, owns it) for every cell that a point owns or visits; the part is told by the cell's hash."""
    points = segment_counts(prints)
    for part in range(parts):
        own = np.arange(part, 32, parts, dtype=np.uint64)
        mask = np.bitwise_or.reduce(np.uint64(3) << (np.uint64(2) * own))
        here, salt = points & mask, np.uint64(part) * np.uint64(0x9E3779B97F4A7C15)
        yield here ^ salt, prints, True
        for segment in own:
            shift = np.uint64(2) * segment
            room = (here >> shift) & np.uint64(3) < 2
            yield (here[room] + (np.uint64(1) << shift)) ^ salt, prints[room], False


def _cells(parts: int):
    def run(batches):
        for batch in batches:
            for cell, prints, own in grid(np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint64), parts):
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(np.full(len(cell), own))], ["cell", "print", "own"])

    return run


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    near = manhattan(segment_counts(a), segment_counts(b)) <= radius
    near[near] = np.bitwise_count((a ^ b)[near]) <= radius
    return near


def connected(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the smallest node each is connected to, where that is another one."""
    nodes, both = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = both[: len(left)], both[len(left) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            other = label != np.arange(len(nodes))
            return nodes[other], nodes[label[other]]


def dense_links(own: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``connected`` for the near ones among all pairs of owners and points, in blocks of owners."""
    a, b, none = own.copy(), points.copy(), np.uint64(2**64 - 1)
    step = max(1, PAIRS // len(points))
    while True:
        before = a.copy(), b.copy()
        for at in range(0, len(own), step):
            block = slice(at, at + step)
            x, y = np.broadcast_arrays(own[block, None], points[None, :])
            near = _near(x, y, radius)
            a[block] = np.minimum(a[block], np.where(near, b[None, :], none).min(axis=1))
            b = np.minimum(b, np.where(near, a[block, None], none).min(axis=0))
        if (a == before[0]).all() and (b == before[1]).all():
            nodes, label = np.concatenate([own, points]), np.concatenate([a, b])
            other = nodes != label
            return nodes[other], label[other]


def _tile_links(cells: np.ndarray, prints: np.ndarray, own: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of whole tiles, given sorted by tile: the small ones at once, each large one by itself."""
    new = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    tile = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(cells))))
    owners, points = prints[own], prints[~own]
    a, b = np.bincount(tile[own], minlength=len(new)), np.bincount(tile[~own], minlength=len(new))
    first_a, first_b = np.cumsum(a) - a, np.cumsum(b) - b
    large = a * b > PAIRS // 8
    for t in np.flatnonzero(large):
        yield dense_links(owners[first_a[t] : first_a[t] + a[t]], points[first_b[t] : first_b[t] + b[t]], radius)
    small = np.flatnonzero(~large & (a > 0) & (b > 0))
    total = np.cumsum(a[small] * b[small])
    at = 0
    while at < len(small):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        some = small[at:to]
        pairs = a[some] * b[some]
        within = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        width = np.repeat(b[some], pairs)
        x, y = owners[np.repeat(first_a[some], pairs) + within // width], points[np.repeat(first_b[some], pairs) + within % width]
        near = (x != y) & _near(x, y, radius)
        yield connected(x[near], y[near])
        at = to


def _links(radius: int):
    """Over rows sorted by tile: links, with the tile that a batch leaves open carried to the next."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def done(rows):
            for a, b in _tile_links(*rows, radius):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            cells, prints, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            rows = tuple(np.concatenate([*(h[i] for h in held), x]) for i, x in enumerate((cells, prints.view(np.uint64), own)))
            open_from = int(np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))[-1]) if len(rows[0]) else 0
            if open_from:
                yield from done(tuple(r[:open_from] for r in rows))
            held = [tuple(r[open_from:] for r in rows)]
        if held and len(held[0][0]):
            yield from done(held[0])

    return run


def near_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) of fingerprints: links that connect just what lies at most ``radius`` bits apart. ``prints`` has one column of distinct ones."""
    cells = prints.select("print").mapInArrow(_cells(radius // 2 + 1), "cell long, print long, own boolean")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("points"), F.count_if("own").alias("owners")).where("points > 1 and owners > 0")
    met = cells.join(sizes.hint("merge"), "cell").select(  # Spark takes a print's cells, dozens, for one row and would send them all
        "cell", "print", "own", F.ceil(F.col("owners") / TILE).alias("rows"), F.ceil(F.col("points") / TILE).alias("columns"))
    row, column = F.pmod(F.xxhash64("print"), F.col("rows")), F.pmod(F.xxhash64("print", F.lit(1)), F.col("columns"))
    asks = met.where("own").select("cell", "print", F.lit(True).alias("own"), row.alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("c"))
    asked = met.select("cell", "print", F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("r"), column.alias("c"))
    tiles = asks.union(asked).select(F.xxhash64("cell", "r", "c").alias("tile"), "print", "own")  # two tiles under one hash only compare more
    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_links(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """Row per document: its id as ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id that links reach."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    light = stored(texts.mapInArrow(_fingerprint_rows(words), "doc_id long, print long"), "prints")
    with_id = light.where("doc_id is not null")
    sets = stored(with_id.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-prints")
    links = near_links(sets, radius)
    repeated = with_id.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("z")).where("a <> z").select("doc_id", "a")
    same = with_id.join(repeated, "doc_id").select("a", F.col("print").alias("b"))  # the texts of one id hang together
    classes = components(links.union(same))
    named = sets.join(classes, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    named = stored(named, "classes")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = light.join(named.join(least, "component").select("print", "component_id"), "print", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
