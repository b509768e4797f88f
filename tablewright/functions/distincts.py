"""Distinct counts of many columns in one scan, without a copy of each row per column.

The JVM turns every cell into 64 bits. Tasks keep one set per column and give its members on by ranges of the bits, at once when the sets
grow beyond ``HELD``; each (column, range) is made one set and counted. The number of ranges follows the size of the table. Of types of up to eight bytes the bits are the value itself, one to one. Of
others, such as text, they are a hash: a count of n falls short with a chance of about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD = 1 << 21
FOLD = 1 << 16
RANGE_BYTES = 1 << 23  # of the table, per range; columnar files hold a key in a byte or two, so a range may have some million members
SETS = "key int, range long, bits binary, present long, rows long"
NAMES = ["key", "range", "bits", "present", "rows"]


def ranges_of(df: DataFrame) -> int:
    """A power of two: a range for each ``RANGE_BYTES`` that the table is estimated to have, 2 ** 20 at most."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << min(20, max(0, (size // RANGE_BYTES).bit_length()))


def _sets(ranges: int):
    """(key, range, bits) of the distinct cells, and (key, present, rows) once per task."""
    return lambda batches: _task_sets(batches, np.uint64(65 - ranges.bit_length()))


def _task_sets(batches: Iterator[pa.RecordBatch], shift: np.uint64) -> Iterator[pa.RecordBatch]:
    sets: dict[int, list[np.ndarray]] = {}
    sizes: dict[int, int] = {}
    fresh: dict[int, int] = {}
    present, rows = np.zeros(0, dtype=np.int64), 0

    def members(key: int) -> Iterator[pa.RecordBatch]:
        bits = np.sort(pd.unique(np.concatenate(sets.pop(key))).view(np.uint64))
        place = bits >> shift if shift < 64 else np.zeros(len(bits), dtype=np.uint64)
        own, first = np.unique(place, return_index=True)
        none = pa.nulls(len(own), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(own), key, dtype=np.int32)), pa.array(own.astype(np.int64)), pa.array([b.tobytes() for b in np.split(bits, first[1:])][: len(own)], pa.binary()), none, none], NAMES)

    for batch in batches:
        rows += batch.num_rows
        if not len(present):
            present = np.zeros(batch.num_columns, dtype=np.int64)
        for key, column in enumerate(batch.columns):
            bits = column.drop_null().to_numpy() if column.null_count else column.to_numpy()
            present[key] += len(bits)
            sets.setdefault(key, []).append(pd.unique(bits))
            fresh[key] = fresh.get(key, 0) + len(sets[key][-1])
            if fresh[key] > FOLD + sizes.get(key, 0):  # as much again as the set itself: fold it in
                sets[key] = [pd.unique(np.concatenate(sets[key]))]
                sizes[key], fresh[key] = len(sets[key][0]), 0
        if sum(sizes.values()) > HELD:
            largest = max(sizes, key=sizes.get)
            yield from members(largest)
            sizes[largest] = fresh[largest] = 0
    for key in list(sets):
        yield from members(key)
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(present), dtype=np.int32)), pa.nulls(len(present), pa.int64()), pa.nulls(len(present), pa.binary()), pa.array(present), pa.array(np.full(len(present), rows))], NAMES)


def _one_set(table: pa.Table) -> pa.Table:
    """Distinct members of one (key, range); the rows without bits add up. The members are copied once and sorted in place."""
    parts = [np.frombuffer(b.as_buffer(), dtype=np.uint64) for chunk in table["bits"].chunks for b in chunk if b.is_valid]
    bits = np.concatenate(parts) if len(parts) > 1 else np.empty(0, dtype=np.uint64)
    bits.sort()
    count = int(np.count_nonzero(bits[1:] != bits[:-1])) + 1 if len(bits) else sum(map(len, parts))
    add = lambda c: sum(x for x in table[c].to_pylist() if x)
    return pa.table({"key": pa.array([table["key"][0].as_py()], pa.int32()), "distinct": [count], "present": [add("present")], "rows": [add("rows")]})


def cell_bits(x: Column) -> Column:
    """64 bits of a cell, NULL of NULL."""
    return F.when(x.isNotNull(), F.xxhash64(x))


def distincts(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """(name, distinct, present, rows) for each named expression over the table; no row for any of an empty table."""
    if not cells:
        return df.sparkSession.createDataFrame([], "name string, distinct long, present long, rows long")
    coded = df.select(*[cell_bits(x).alias(f"c{i}") for i, x in enumerate(cells.values())])
    parts = coded.mapInArrow(_sets(ranges_of(df)), SETS).groupBy("key", "range").applyInArrow(_one_set, "key int, distinct long, present long, rows long")
    counts = parts.groupBy("key").agg(F.sum("distinct").alias("distinct"), F.sum("present").alias("present"), F.sum("rows").alias("rows"))
    return counts.select(F.array(*[F.lit(n) for n in cells])[F.col("key")].alias("name"), "distinct", "present", "rows")


FOLD_BYTES, FOLD_ROWS = 1 << 25, 10_000


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def counts():
        for key, column in enumerate(pa.Table.from_batches(held).columns):
            found = pc.value_counts(column.combine_chunks())
            for at in range(0, len(found), FOLD_ROWS):
                some = found.slice(at, FOLD_ROWS)
                value, n = some.flatten()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), key, dtype=np.int32)), value.cast(pa.string()), n.cast(pa.int64())], ["key", "value", "n"])

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > FOLD_BYTES:
            yield from counts()
            held, size = [], 0
    if held:
        yield from counts()


def folded_values(df: DataFrame) -> DataFrame:
    """(key, value, n): the values of each text column, NULL too, by its place, with how often they come in a stretch of rows of about ``FOLD_BYTES``.

    What is asked of every value is then asked once of equal ones. Nothing is shuffled, so a value comes once per stretch; counts add up to the rows.
    """
    return df.mapInArrow(_folded, "key int, value string, n long")
