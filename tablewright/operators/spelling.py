"""Similar spellings among any number of strings of any length: a complete similarity join.

*Likeness* of two strings is 2 * M / (their lengths), M the characters in matching blocks: the longest common block, the first one of
those, and likewise on either side of it. ``LIKE`` or more counts, as written or with words sorted; where more than ``EDITS`` characters must be edited, only
``VERY_LIKE`` or more.

*Prefix filter.* M never exceeds the longest common subsequence, so likeness bounds how many characters each of two strings has that
the other lacks; a missing character takes at most q runs of q characters with it, one too many at most q - 1. Of all runs of a string (the n-th
copy of a run is a run of its own), ordered rarest first, it therefore needs only as many as can be missing, and one more, to share one with
every string like it. Pairs whose longer string is shorter than ``SHORT`` meet by runs of two, longer ones by runs of four. The order of rarity
comes from a table of at most ``FREQUENT`` runs, which steers cost alone: any order finds the same pairs.

*Scopes.* All strings of a scope of at most ``WHOLE`` meet by the scope itself, one row a string instead of one a run. The table of larger scopes has
``FREQUENT`` entries at most; scopes that it leaves out meet whole too.

*Blocks.* Strings meet per scope and run, in one shuffle. Blocks of one string give nothing, those of at most ``TILE`` strings their pairs; larger ones are
cut into tiles of that size, so a hot run becomes many tasks. Within a tile, lengths and counts of characters close most pairs before they leave it.

*Scoring.* Matching blocks are found for many pairs at once, as array work over padded code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import cut_lineage

LIKE, VERY_LIKE, EDITS = 0.85, 0.92, 4
SHORT = 24
FREQUENT = 1 << 16
WHOLE = 64
TILE = 1 << 12
PAIRS, PAIRS_AT_ONCE = 1 << 18, 1 << 20
CELLS = 1 << 20
BY_LENGTH = 5  # rule of blocks whose members need only be less than ``EDITS`` apart in length
_BUCKETS = 32  # the last one holds white space
_SPACES = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint32)
_TURN = np.uint64(0x9E3779B97F4A7C15)
_FIRST, _LAST = 0x110000, 0x110001  # code points that no text has


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts end to end, and the length of each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.array([len(t) for t in texts], dtype=np.int64)


def runs(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, run, copy of it) of every run of ``q`` characters, with ``q - 1`` marks before and after each text."""
    points, size = code_points(texts)
    wide = size + 2 * (q - 1)
    ends = np.cumsum(wide)
    padded = np.full(int(wide.sum()), _FIRST, dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), wide)
    place = np.arange(len(padded)) - (ends - wide)[owner]
    padded[place >= q - 1 + size[owner]] = _LAST
    padded[(place >= q - 1) & (place < q - 1 + size[owner])] = points
    total = np.zeros(len(padded), dtype=np.uint64)
    for k in range(q):
        total[: len(padded) - k] = total[: len(padded) - k] * _TURN + padded[k:]
    inside = place < size[owner] + q - 1
    owner, run = owner[inside], _mixed(total[inside])
    order = np.lexsort((run, owner))
    owner, run = owner[order], run[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (run[1:] != run[:-1])) if len(owner) else np.empty(0, dtype=bool)
    at = np.flatnonzero(new)
    copy = np.arange(len(owner)) - np.repeat(at, np.diff(np.append(at, len(owner))))
    return owner, run, copy


def may_miss(size: np.ndarray, q: int, by_words: bool) -> np.ndarray:
    """How many runs of a string of that length a string like it may lack.

    As written: those of ``EDITS`` edits, or of likeness ``VERY_LIKE``, where the other string has at least 23/27 of the length.
    With words sorted: those of likeness ``LIKE`` (17/23 of the length) for short strings and ``VERY_LIKE`` for long ones, whose pairs of less
    likeness have few edits as written.
    """
    very = q * 4 * size // 27
    if by_words:
        return q * 6 * size // 23 if q == 2 else very
    return np.maximum(EDITS * q, very)


def character_counts(texts: list[str]) -> np.ndarray:
    """(texts, buckets): how many characters of each text fall in each bucket."""
    points, size = code_points(texts)
    bucket = np.where(np.isin(points, _SPACES), _BUCKETS - 1, points % (_BUCKETS - 1))
    return np.bincount(np.repeat(np.arange(len(texts)), size) * _BUCKETS + bucket, minlength=len(texts) * _BUCKETS).reshape(len(texts), _BUCKETS)


def may_be_alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Can strings of these character counts have likeness ``LIKE``, as written or with words sorted?"""
    common = np.minimum(a, b).astype(np.int32)
    shown = common[:, :-1].sum(axis=1)
    total = a[:, :-1].sum(axis=1, dtype=np.int32) + b[:, :-1].sum(axis=1, dtype=np.int32)
    return 40 * shown >= 17 * total - 6 * common[:, -1]


def matched(a: list[str], b: list[str]) -> np.ndarray:
    """Characters in the matching blocks of each pair of texts."""
    total = np.zeros(len(a), dtype=np.int64)
    sizes = np.array([max(len(y), 1) for y in b])
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * sizes[order[to]] <= CELLS:
            to += 1
        some = order[at:to]
        total[some] = _matched([a[i] for i in some], [b[i] for i in some])
        at = to
    return total


def _padded(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points with one text per column, and the lengths."""
    points, size = code_points(texts)
    out = np.full((len(texts), max(1, int(size.max(initial=0)))), pad, dtype=np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = points
    return np.ascontiguousarray(out.T), size


def _matched(a: list[str], b: list[str]) -> np.ndarray:
    left, high_a = _padded(a, _FIRST)
    right, high_b = _padded(b, _LAST)
    total = np.zeros(len(a), dtype=np.int64)
    pair = np.flatnonzero((high_a > 0) & (high_b > 0))
    low_a, low_b = np.zeros(len(pair), dtype=np.int64), np.zeros(len(pair), dtype=np.int64)
    high_a, high_b = high_a[pair], high_b[pair]
    while len(pair):
        width = int((high_b - low_b).max())
        places = low_b + np.arange(width)[:, None]
        there = np.where(places < high_b, right[np.minimum(places, len(right) - 1), pair], _LAST)
        run, before = np.zeros((width + 1, len(pair)), dtype=np.int32), np.zeros((width + 1, len(pair)), dtype=np.int32)
        best, best_a, best_b = (np.zeros(len(pair), dtype=np.int64) for _ in range(3))
        for step in range(int((high_a - low_a).max())):
            i = low_a + step
            letter = np.where(i < high_a, left[np.minimum(i, len(left) - 1), pair], _FIRST)
            run, before = before, run  # lengths of equal runs that end at (i, place)
            np.multiply(before[:-1] + 1, there == letter, out=run[1:])
            size = run.max(axis=0)
            better = np.flatnonzero(size > best)
            if len(better):
                j = run[:, better].argmax(axis=0)
                best[better] = size[better]
                best_a[better], best_b[better] = i[better] - size[better] + 1, low_b[better] + j - size[better]
        np.add.at(total, pair, best)
        before = (best > 0) & (best_a > low_a) & (best_b > low_b)
        after = (best > 0) & (best_a + best < high_a) & (best_b + best < high_b)
        pair, low_a, high_a, low_b, high_b = (
            np.concatenate(x) for x in ((pair[before], pair[after]), (low_a[before], (best_a + best)[after]), (best_a[before], high_a[after]),
                                        (low_b[before], (best_b + best)[after]), (best_b[before], high_b[after])))
    return total


def likeness(a: list[str], b: list[str], sorted_a: list[str], sorted_b: list[str]) -> np.ndarray:
    """The larger likeness of each pair, as written and with words sorted; 0 where characters alone rule out ``LIKE``."""
    out = np.zeros(len(a))
    open_ = np.flatnonzero(may_be_alike(character_counts(a), character_counts(b)))
    for x, y in ((a, b), (sorted_a, sorted_b)):
        p, r = [x[i] for i in open_], [y[i] for i in open_]
        length = np.array([len(s) + len(t) for s, t in zip(p, r)], dtype=float)
        ratio = np.where(length > 0, 2.0 * matched(p, r) / np.maximum(length, 1.0), 1.0)
        out[open_] = np.maximum(out[open_], ratio)
    return out


# --------------------------------------------------------------------------- the join


def _frequencies(large: np.ndarray):
    """(run, times) over the texts of a batch that lie in the large scopes and have runs of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(np.isin(batch.column(1).to_numpy(), large)))
            for texts in (batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                for q, own in ((2, [t for t in texts if len(t) < SHORT]), (4, [t for t in texts if len(t) + EDITS >= SHORT])):
                    found, times = np.unique(runs(own, q)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], ["run", "times"])

    return run


def _prefixes(large: np.ndarray, frequent: np.ndarray, times: np.ndarray):
    """(key, id, size, rule, counts) of the runs that each string of a large scope meets others by; the key tells scope, kind and run. In other scopes a string has
    one row of a kind, for the whole scope."""

    def run(batches):
        for batch in batches:
            scope = np.ascontiguousarray(batch.column(1).to_numpy()).view(np.uint64)
            by_runs = np.isin(batch.column(1).to_numpy(), large)
            for by_words, texts in ((False, batch.column(2).to_pylist()), (True, batch.column(3).to_pylist())):
                size = np.array([len(t) for t in texts], dtype=np.int64)
                for q, own in ((2, np.flatnonzero(size < SHORT)), (4, np.flatnonzero(size + EDITS >= SHORT))):
                    rule = 2 * by_words + (q == 4)
                    turned = np.uint64((rule + 1) * int(_TURN) % 2**64)
                    owner, found, copy = runs([texts[i] if by_runs[i] else "" for i in own], q)
                    one = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.empty(0, dtype=bool)
                    whole = ~by_runs[own][owner]
                    found[whole] = 0
                    owner, found, copy = (x[one | ~whole] for x in (owner, found, copy))
                    place = np.minimum(np.searchsorted(frequent, found), max(len(frequent) - 1, 0))
                    weight = np.where(frequent[place] == found, times[place], 0) if len(frequent) else np.zeros(len(found), dtype=np.int64)
                    order = np.lexsort((copy, found, weight, owner))
                    owner, found, copy = owner[order], found[order], copy[order]
                    first = np.searchsorted(owner, np.arange(len(own)))
                    taken = np.arange(len(owner)) - first[owner] <= may_miss(size[own], q, by_words)[owner]
                    owner, found, copy = owner[taken], found[taken], copy[taken]
                    key = _mixed(found + _TURN * copy.astype(np.uint64) ^ _mixed(scope[own][owner] + turned))
                    if q == 2:
                        counts = character_counts([texts[i] for i in own]).astype(np.uint8)
                        sent = pa.Array.from_buffers(pa.binary(_BUCKETS), len(owner), [None, pa.py_buffer(np.ascontiguousarray(counts[owner]))]).cast(pa.binary())
                    else:
                        sent = pa.array([b""] * len(owner), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), batch.column(0).take(pa.array(own[owner])), pa.array(size[own][owner].astype(np.int32)), pa.array(np.full(len(owner), rule, dtype=np.int32)), sent],
                        ["key", "id", "size", "rule", "counts"])

    return run


def _fits(size_a: np.ndarray, size_b: np.ndarray, rule: np.ndarray) -> np.ndarray:
    """Can strings of these lengths be alike by the rule of the block they meet in?"""
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    very = 27 * low >= 23 * high
    if len(rule) and rule[0] == BY_LENGTH:
        return high - low < EDITS
    return np.where(rule < 2, very | (high - low <= EDITS), np.where(rule == 2, 23 * low >= 17 * high, very))


def _block_pairs(tile, ids, size, rule, part, whole, counts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of the pairs of each tile that lengths and character counts leave open; rows are sorted by tile."""
    new = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
    many = np.diff(np.append(new, len(tile)))
    ends = np.cumsum(many * many)
    for at in range(0, int(ends[-1]), PAIRS):
        pair = np.arange(at, min(at + PAIRS, int(ends[-1])))
        own = np.searchsorted(ends, pair, "right")
        within = pair - (ends[own] - many[own] * many[own])
        i, j = new[own] + within // many[own], new[own] + within % many[own]
        ok = (ids[i] < ids[j]) & (whole[i] | (part[i] != part[j])) & (rule[i] == rule[j])
        ok[ok] = _fits(size[i[ok]], size[j[ok]], rule[i[ok]])
        i, j = i[ok], j[ok]
        short = (rule[i] == 0) | (rule[i] == 2)
        alike = np.ones(len(i), dtype=bool)
        alike[short] = may_be_alike(counts[i[short]], counts[j[short]])
        yield ids[i[alike]], ids[j[alike]]


def _pairs_of(rows) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The open pairs of all tiles in ``rows``, some ``PAIRS_AT_ONCE`` together, each once there."""
    pairs, n = [], 0

    def once():
        a, b = (np.concatenate(x) for x in zip(*pairs))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        return pa.array(a[new]), pa.array(b[new])

    for p in _block_pairs(*rows):
        if len(p[0]):
            pairs.append(p)
            n += len(p[0])
        if n >= PAIRS_AT_ONCE:
            yield once()
            pairs, n = [], 0
    if pairs:
        yield once()


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1]))


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """All columns as arrays; the last one, character counts, only where a short string has any."""
    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]
    counts, rule = np.zeros((batch.num_rows, _BUCKETS), dtype=np.uint8), columns[3]
    short = (rule == 0) | (rule == 2)
    counts[short] = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).filter(pa.array(short)).to_pylist()), dtype=np.uint8).reshape(-1, _BUCKETS)
    return [*columns, counts]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by tile: candidate pairs, each once per batch; the tile that a batch leaves open is carried on."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = _columns(batch)
        rows = [np.concatenate([h, c]) for h, c in zip(held, columns)] if held else columns
        last = int(_starts(rows[0])[-1])
        if last:
            for a, b in _pairs_of([r[:last] for r in rows]):
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])
        held = [r[last:] for r in rows]
    if held:
        for a, b in _pairs_of(held):
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])


_MET = "a long, b long, key long, size int, rule int, counts binary"


def _met_by_key(most: int):
    """Over rows sorted by key: the candidate pairs (a, b) of blocks of at most ``most`` strings; the rows of larger blocks as they are, with no b."""
    names = [f.split(" ")[0] for f in _MET.split(", ")]

    def as_rows(key, ids, size, rule, counts):
        if len(key):
            sent = pa.Array.from_buffers(pa.binary(_BUCKETS), len(key), [None, pa.py_buffer(np.ascontiguousarray(counts))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(key), pa.int64()), pa.array(key), pa.array(size), pa.array(rule), sent], names)

    def done(rows, large):
        yield from as_rows(*[r[large] for r in rows])
        key, ids, size, rule, counts = (r[~large] for r in rows)
        if len(key):
            for a, b in _pairs_of((key, ids, size, rule, np.zeros(len(key), dtype=np.int64), np.ones(len(key), dtype=bool), counts)):
                yield pa.RecordBatch.from_arrays([a, b, *(pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        hot = None  # key of a block that is known to be large
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = _columns(batch)
            rows = [np.concatenate([h, c]) for h, c in zip(held, columns)] if held else columns
            new = _starts(rows[0])
            many = np.diff(np.append(new, len(rows[0])))
            large = many > most
            large[0] |= hot is not None and rows[0][0] == hot
            hot = rows[0][-1] if large[-1] else None
            keep = len(rows[0]) if large[-1] else int(new[-1])
            if keep:
                yield from done([r[:keep] for r in rows], np.repeat(large, many)[:keep])
            held = [r[keep:] for r in rows] if keep < len(rows[0]) else []
        if held:
            yield from done(held, np.zeros(len(held[0]), dtype=bool))

    return run


def meeting_rows(strings: DataFrame) -> DataFrame:
    """(key, id, size, rule, counts): what strings meet by."""
    columns = strings.select("id", "scope", "form", "sorted")
    scopes = columns.groupBy("scope").agg(F.count(F.lit(1)).alias("strings")).where(F.col("strings") > WHOLE)
    large = np.sort(scopes.orderBy(F.desc("strings"), "scope").limit(FREQUENT).toArrow()["scope"].to_numpy().astype(np.int64))
    frequent = times = np.empty(0, dtype=np.int64)
    if len(large):
        top = columns.mapInArrow(_frequencies(large), "run long, times long").groupBy("run").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "run").limit(FREQUENT).toArrow()
        frequent, times = top["run"].to_numpy().astype(np.int64), top["times"].to_numpy().astype(np.int64)
    frequent = frequent.view(np.uint64)
    rising = np.argsort(frequent)
    return columns.mapInArrow(_prefixes(large, frequent[rising], times[rising]), "key long, id long, size int, rule int, counts binary")


def candidate_pairs(strings: DataFrame) -> DataFrame:
    """(a, b), a < b, of the ids that may be alike; no pair that is alike is missing.

    ``strings`` has id, scope (a number; pairs stay inside one scope), form and sorted, and must give the same rows whenever it is read.
    """
    return block_pairs(meeting_rows(strings))


def block_pairs(rows: DataFrame) -> DataFrame:
    """(a, b), a < b, of the ids that share a key and whose lengths and character counts fit: rows (key, id, size, rule, counts).

    Spark cannot tell how many rows come out of array functions, so no join here is left to its estimate: it would broadcast them.
    """
    met = cut_lineage(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_met_by_key(TILE), _MET))
    large = met.where("b IS NULL").select("key", F.col("a").alias("id"), "size", "rule", "counts")
    parts = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    placed = large.join(parts.hint("merge"), "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tiles = tiles.select(
        F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), "id", "size", "rule", "part", (F.col("part") == F.col("other")).alias("whole"), "counts")
    tiled = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_met, "a long, b long")
    return met.where("b IS NOT NULL").select("a", "b").union(tiled).distinct()


def with_likeness(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``ratio``, the likeness of the columns a and b, or of sa and sb, whichever is larger."""
    names = pairs.columns

    def score(batches):
        for batch in batches:
            a, b, sa, sb = (batch.column(names.index(n)).to_pylist() for n in ("a", "b", "sa", "sb"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(likeness(a, b, sa, sb))], [*names, "ratio"])

    return pairs.mapInArrow(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", ratio double")
