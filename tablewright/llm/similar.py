"""Similarity join of whole texts on word shingles with a token-group matrix.

Distinct shingle sets are partitioned into groups of similar sets: a group is all sets whose smallest shingle by
two hashes is the same, which sets of similarity s share with a chance of about s * s. Any partition gives exact results; a good one
keeps near copies together. Three steps lead from groups to links:

1. *Matrix.* A row (shingle, group) says that a group's union holds a shingle. Only the rows that can matter are made:
   if two sets are at least t similar, then, in any common order and for any k up to their overlap, the first
   n - ceil(t * n) + k shingles of both hold k common ones. These are indexed, rarest first, with k = n / ``DEEPER``. Rows are kept
   once per group, however many sets share them.
2. *Bound.* Of two sets, one has the earlier last indexed shingle; all that it shares up to there is indexed by both, and
   all that it can share beyond is the rest of it, so the number of shared indexed shingles and the sizes bound the overlap. Groups that
   share too few for any of their sizes, or whose sizes are too far apart, stay closed. The others are stored as blocks of sets of bounded size, each with the union of its
   shingles; no set of a block can overlap a query in more shingles than the union does, which closes blocks and queries within them.
3. *Open.* Of two blocks the lighter one asks. A task holds one block and a bounded number of the sets that ask it; in what
   its bounds leave open, overlaps are counted exactly, as a matrix product. It returns each linked set once, with the
   smallest set it is connected to, so nothing quadratic leaves a task.

The order of rarity comes from a table of at most ``FREQUENT`` shingles that repeat, counted over all texts. It bounds a
broadcast and steers cost only: any order gives the same links.

Defined cases: null and empty texts have no shingles and no links. A repeated id is one document whose rows
count as linked. Rows whose id is null come back with a null component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import components, shuffle_partitions, stored
from tablewright.llm.words import mixed, slice_shingles, slice_words, text_slices

FREQUENT = 1 << 17
DEEPER = 16
BLOCK_SHINGLES = 1 << 17
BLOCK_SETS = 1 << 10
WINDOW = 1 << 19
FILTER_BITS = 1 << 23
PACK = "block long, ids binary, sizes binary, shingles binary"


def _bytes(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


class _Sets:
    """Shingle sets of the texts of one slice."""

    def __init__(self, ids: pa.Array, data: np.ndarray, starts: np.ndarray, n: int):
        text, _, _, words = slice_words(data, starts)
        self.ids, count = ids, len(starts) - 1  # ids: an Arrow array, which keeps nulls and all digits
        self.owner, self.hashes = slice_shingles(text, words, n, count)
        self.sizes = np.bincount(self.owner, minlength=count)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        full = np.flatnonzero(self.sizes)
        self.key, self.one, self.two = (np.zeros(count, dtype=np.uint64) for _ in range(3))
        if len(full):
            other = mixed(self.hashes ^ np.uint64(0x2545F4914F6CDD1D))
            self.key[full] = mixed(self.hashes[self.ends[full]]) ^ np.minimum.reduceat(other, self.ends[full])
            self.one[full] = np.add.reduceat(mixed(self.hashes), self.ends[full])
            self.two[full] = np.add.reduceat(mixed(self.hashes ^ np.uint64(0x5851F42D4C957F2D)), self.ends[full])


def _each(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[_Sets]:
    for batch in batches:
        for row, data, starts in text_slices(batch.column(1)):
            yield _Sets(batch.column(0).slice(row, len(starts) - 1), data, starts, n)


def _facts(n: int):
    def run(batches):
        seen, window, held = set(), [], 0

        def repeated():
            values, counts = np.unique(np.concatenate(window), return_counts=True)
            values, counts = values[counts > 1], counts[counts > 1]
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays([none] * 5 + [pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names)

        names = ["doc_id", "n", "one", "two", "key", "shingle", "times"]
        for s in _each(batches, n):
            none = pa.nulls(len(s.ids), pa.int64())
            yield pa.RecordBatch.from_arrays([s.ids, pa.array(s.sizes.astype(np.int64)), pa.array(s.one.view(np.int64)), pa.array(s.two.view(np.int64)), pa.array(s.key.view(np.int64)), none, none], names)
            for i, sig in enumerate(zip(s.one.tolist(), s.two.tolist())):
                if sig not in seen:
                    seen.add(sig)
                    window.append(s.hashes[s.ends[i] : s.ends[i + 1]])
                    held += s.sizes[i]
            if held > WINDOW:
                yield repeated()
                seen, window, held = set(), [], 0
        if window:
            yield repeated()

    return run


def _matrix(n: int, percent: int, buckets: int, frequent: np.ndarray, weight: np.ndarray):
    """Rows (bucket, shingles, groups): the indexed part of the matrix, packed."""

    def packed(shingles, groups):
        shingles, groups = np.concatenate(shingles), np.concatenate(groups)
        order = np.lexsort((groups, shingles))
        shingles, groups = shingles[order], groups[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (groups[1:] != groups[:-1])
        shingles, groups = shingles[new], groups[new]
        bucket = (mixed(shingles) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, shingles, groups = bucket[order], shingles[order], groups[order]
        own, at = np.unique(bucket, return_index=True)
        cuts = at[1:]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), _bytes(np.split(shingles, cuts)), _bytes(np.split(groups, cuts))], ["bucket", "shingles", "groups"])

    def run(batches):
        shingles, groups, held = [], [], 0
        for s in _each(batches, n):
            place = np.searchsorted(frequent, s.hashes) if len(frequent) else np.zeros(len(s.hashes), dtype=np.int64)
            times = np.zeros(len(s.hashes), dtype=np.int64)
            if len(frequent):
                place = np.minimum(place, len(frequent) - 1)
                hit = frequent[place] == s.hashes
                times[hit] = weight[place[hit]]
            order = np.lexsort((s.hashes, times, s.owner))
            owner = s.owner[order]
            rank = np.arange(len(owner)) - s.ends[owner]
            sizes = s.sizes[owner]
            keep = rank < sizes - -(-percent * sizes // 100) + np.maximum(1, sizes // DEEPER)
            shingles.append(s.hashes[order][keep])
            groups.append(s.key[owner[keep]])
            held += int(keep.sum())
            if held > WINDOW:
                yield packed(shingles, groups)
                shingles, groups, held = [], [], 0
        if held:
            yield packed(shingles, groups)

    return run


def _shared_shingles(table: pa.Table) -> pa.Table:
    """Rows (shingle, group) of one bucket for the shingles that more than one group indexes."""
    shingles = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in table["shingles"]])
    groups = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in table["groups"]])
    order = np.lexsort((groups, shingles))
    shingles, groups = shingles[order], groups[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (groups[1:] != groups[:-1])
    shingles, groups = shingles[new], groups[new]
    same = shingles[1:] == shingles[:-1]
    keep = np.zeros(len(shingles), dtype=bool)
    keep[1:] |= same
    keep[:-1] |= same
    return pa.table({"shingle": shingles[keep], "grp": groups[keep]})


def _whole_sets(n: int, bits: np.ndarray):
    """Rows (doc_id, one, two, set) of the texts that may be members of a candidate group."""

    def run(batches):
        for s in _each(batches, n):
            place = mixed(s.one ^ s.two) % np.uint64(FILTER_BITS)
            take = np.flatnonzero((bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 & (s.sizes > 0))
            yield pa.RecordBatch.from_arrays([s.ids.take(pa.array(take)), pa.array(s.one[take].view(np.int64)), pa.array(s.two[take].view(np.int64)), _bytes([s.hashes[s.ends[i] : s.ends[i + 1]] for i in take])], ["doc_id", "one", "two", "shingles"])

    return run


def _pack(table: pa.Table) -> pa.Table:
    rows = sorted(set(zip(table["rep"].to_pylist(), (x.as_py() for x in table["shingles"]))))  # a repeated row is one set
    sets = [np.frombuffer(x, dtype=np.uint64) for _, x in rows]
    ids = np.array([i for i, _ in rows])
    return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int64()), "ids": [ids.astype(np.int64).tobytes()], "sizes": [np.array([len(x) for x in sets], dtype=np.int64).tobytes()], "shingles": [np.concatenate(sets).tobytes()]})


def linked(a: tuple, b: tuple, percent: int) -> list[tuple[int, int]]:
    """Links between the sets of two blocks (ids, sizes, shingles), as (id, smallest id it is connected to)."""
    sides = []
    for (own_ids, sizes, shingles), (_, other_sizes, other) in ((a, b), (b, a)):
        union = np.unique(other)
        place = np.minimum(np.searchsorted(union, shingles), len(union) - 1)
        common = union[place] == shingles
        owner = np.repeat(np.arange(len(sizes)), sizes)
        bound = np.bincount(owner[common], minlength=len(sizes))
        opened = (100 * bound >= percent * np.maximum(sizes, other_sizes.min())) & (100 * other_sizes.max() >= percent * sizes)
        if not opened.any():
            return []
        keep = common & opened[owner]
        number = np.cumsum(opened) - 1
        sides.append((own_ids[opened], sizes[opened], number[owner[keep]], shingles[keep]))
    (ia, na, oa, ta), (ib, nb, ob, tb) = sides
    tokens = np.intersect1d(ta, tb)
    if np.isin(ia, ib).any():  # sets on both sides: what one set alone holds adds nothing to a pair
        every, owner = np.concatenate([ta, tb]), np.concatenate([ia[oa], ib[ob]])
        order = np.lexsort((owner, every))
        every, owner = every[order], owner[order]
        other = (every[1:] == every[:-1]) & (owner[1:] != owner[:-1])
        tokens = np.unique(every[1:][other])
    width = int(np.clip((1 << 22) // max(len(ia), len(ib)), 64, 4096))
    overlap = np.zeros((len(ia), len(ib)), dtype=np.float32)
    pa_, pb_ = np.searchsorted(tokens, ta), np.searchsorted(tokens, tb)
    pa_[pa_ == len(tokens)] = 0
    pb_[pb_ == len(tokens)] = 0
    if not len(tokens):
        return []
    ga, gb = tokens[pa_] == ta, tokens[pb_] == tb
    oa, pa_, ob, pb_ = oa[ga], pa_[ga], ob[gb], pb_[gb]
    for start in range(0, len(tokens), width):
        one, two = np.zeros((len(ia), width), dtype=np.float32), np.zeros((len(ib), width), dtype=np.float32)
        x, y = (pa_ >= start) & (pa_ < start + width), (pb_ >= start) & (pb_ < start + width)
        one[oa[x], pa_[x] - start] = 1
        two[ob[y], pb_[y] - start] = 1
        overlap += one @ two.T
    overlap = overlap.astype(np.int64)
    left, right = np.nonzero((100 * overlap >= percent * (na[:, None] + nb[None, :] - overlap)) & (ia[:, None] != ib[None, :]))
    if not len(left):
        return []
    label_a, label_b = ia.copy(), ib.copy()
    while True:
        before = label_a.sum() + label_b.sum()
        np.minimum.at(label_a, left, label_b[right])
        np.minimum.at(label_b, right, label_a[left])
        if label_a.sum() + label_b.sum() == before:
            break
    found = {(i, int(x)) for i, x in zip(ia.tolist(), label_a) if i != x} | {(i, int(x)) for i, x in zip(ib.tolist(), label_b) if i != x}
    return sorted(found)


def _block(table: pa.Table) -> tuple:
    """Rows of packed sets as one block (ids, sizes, shingles)."""
    return tuple(np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64 if c == "shingles" else np.int64) for x in table[c]]) for c in ("ids", "sizes", "shingles"))


def _open(percent: int):
    def run(queries: pa.Table, group: pa.Table) -> pa.Table:
        found = linked(_block(queries), _block(group), percent) if queries.num_rows and group.num_rows else []
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """Row per document: its id as ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles.
    """
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    facts = stored(texts.mapInArrow(_facts(words), "doc_id long, n long, one long, two long, key long, shingle long, times long"), "facts")
    counts = facts.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).where("times >= 8")
    top = counts.orderBy(F.desc("times"), "shingle").limit(FREQUENT).toArrow()
    frequent, weight = top["shingle"].to_numpy().astype(np.int64).view(np.uint64), top["times"].to_numpy().astype(np.int64)
    rising = np.argsort(frequent)
    frequent, weight = frequent[rising], weight[rising]

    light = facts.where("n is not null").select("doc_id", "n", "one", "two", "key")
    sets = light.where("n > 0 and doc_id is not null").groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("key").alias("key"))
    sets = stored(sets, "sets")
    matrix = texts.where("doc_id is not null").mapInArrow(_matrix(words, percent, buckets, frequent, weight), "bucket long, shingles binary, groups binary")
    rows = stored(matrix.groupBy("bucket").applyInArrow(_shared_shingles, "shingle long, grp long"), "matrix")
    loads = sets.groupBy("key").agg(F.sum("n").alias("load"), F.count(F.lit(1)).alias("members"), F.min("n").alias("low"), F.max("n").alias("high"))
    shared = rows.alias("x").join(rows.alias("y"), F.expr("x.shingle = y.shingle and x.grp < y.grp")).groupBy(F.col("x.grp").alias("g"), F.col("y.grp").alias("h")).agg(F.count(F.lit(1)).alias("shared"))
    sides = [loads.select(F.col("key").alias(k), F.col("low").alias(f"low_{k}"), F.col("high").alias(f"high_{k}")) for k in "gh"]
    least = f"greatest(floor(least(low_g, low_h) / {DEEPER}), 1)"
    overlap, rest = f"ceil({percent} * (low_g + low_h) / {100 + percent})", f"ceil({percent} * greatest(high_g, high_h) / 100)"
    near = shared.join(sides[0], "g").join(sides[1], "h").where(
        f"shared >= greatest({least}, {overlap} - {rest} + {least}) and 100 * high_g >= {percent} * low_h and 100 * high_h >= {percent} * low_g")
    pairs = stored(near.select("g", "h").union(loads.where("members > 1").select("key", "key")), "pairs")

    wanted = pairs.select("g").union(pairs.select("h")).distinct().withColumnRenamed("g", "key")
    parts = loads.join(wanted, "key").select("key", F.ceil(F.greatest(F.col("load") / BLOCK_SHINGLES, F.col("members") / BLOCK_SETS)).alias("parts"))
    members = stored(sets.join(parts, "key").select("rep", "one", "two", "n", "key", F.xxhash64("key", F.pmod(F.xxhash64("one", "two"), "parts")).alias("block")), "members")
    blocks = members.groupBy("key", "block").agg(F.sum("n").alias("load"), F.count(F.lit(1)).alias("members"))
    x = blocks.select(F.col("key").alias("g"), F.struct("load", "block", "members").alias("x"))
    y = blocks.select(F.col("key").alias("h"), F.struct("load", "block", "members").alias("y"))
    tiles = pairs.join(x, "g").join(y, "h").where("g <> h or x <= y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    tiles = stored(tiles.select(F.col("x.block").alias("query"), F.col("y.block").alias("block"), F.col("x.load").alias("load"), F.col("x.members").alias("members")), "tiles")
    # the lighter side asks; a block that many ask meets them in chunks of bounded size
    chunks = tiles.groupBy("block").agg(F.ceil(F.greatest(F.sum("load") / (2 * BLOCK_SHINGLES), F.sum("members") / (2 * BLOCK_SETS))).cast("int").alias("chunks"))
    tiles = tiles.join(chunks, "block").select("query", "block", F.pmod(F.xxhash64("query"), "chunks").cast("int").alias("chunk"))

    bits = _filter_bits(members)
    whole = texts.where("doc_id is not null").mapInArrow(_whole_sets(words, bits), "doc_id long, one long, two long, shingles binary")
    whole = whole.join(members.withColumnRenamed("rep", "doc_id"), ["doc_id", "one", "two"]).select("block", F.col("doc_id").alias("rep"), "shingles")
    packed = stored(whole.groupBy("block").applyInArrow(_pack, PACK), "packed")
    sent = packed.select(F.col("block").alias("query"), *[F.col(c).alias(c) for c in ("ids", "sizes", "shingles")])
    asking = tiles.join(sent, "query").drop("query")
    asked = packed.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    links = asking.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(_open(percent), "a long, b long")
    repeated = light.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    if not repeated.isEmpty():  # the texts of one id hang together
        own = light.join(repeated, "doc_id", "left_semi").select("doc_id", "one", "two").distinct().join(sets.select("rep", "one", "two"), ["one", "two"])
        links = links.union(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    classes = components(links)
    first = sets.select("one", "two", "rep").join(classes, F.col("rep") == F.col("node"), "left").select("one", "two", F.coalesce("component", "rep").alias("component"))
    own = classes.select(F.col("node").alias("doc_id"), F.col("component").alias("own"))
    out = light.join(first, ["one", "two"], "left").join(own, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("own", "component", "doc_id")).alias("component_id"))


def _filter_bits(members: DataFrame) -> np.ndarray:
    """A bit field of fixed size that holds every member's set (and, by chance, others)."""

    def places(batches):
        for batch in batches:
            one, two = (np.ascontiguousarray(batch.column(i).to_numpy()).view(np.uint64) for i in (0, 1))
            place = mixed(one ^ two) % np.uint64(FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(5)).astype(np.int64)), pa.array(np.left_shift(1, (place & np.uint64(31)).astype(np.int64)))], ["word", "bit"])

    rows = members.select("one", "two").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    field = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    field[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return field.view(np.uint8)
