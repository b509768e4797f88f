"""CSV whose quoted values hold line ends, read by many tasks whatever the size of a file.

A file is read as lines, in byte ranges. Whether a line starts inside a quoted value depends on the number of quotes before it, odd or even
(a doubled quote adds two). Each range counts its own; a running sum over the ranges of a file, a row each, gives every
range the state it starts in and the number of records before it. Then every line knows its record: one that starts outside quotes starts a
record, one that starts inside goes on with the last. Only lines of records of several lines meet in a shuffle, by record; all others stay where
they are. The records are parsed with the given schema.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODINGS = ("UTF-8", "ISO-8859-1", "US-ASCII")
RANGES = "file string, start long, quotes long, even long, odd long"
LINES = "file string, record long, place long, several boolean, line string"


def _ranges_of(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, first byte of the range, lines) of a batch, in order."""
    file, start = batch.column(0), batch.column(1)
    key = pc.binary_join_element_wise(file, start.cast(pa.string()), "\n")
    codes = key.dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, dtype=np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(codes)]):
        yield file[a].as_py(), start[a].as_py(), batch.column(2).slice(a, b - a)


def _quotes(lines: pa.Array, quote: str) -> np.ndarray:
    return pc.count_substring(lines, quote).to_numpy(zero_copy_only=False).astype(np.int64)


def _tally(quote: str):
    """Per range: its quotes, and how many records start in it if it starts outside quotes (``even``) or inside (``odd``)."""

    def run(batches):
        found: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for file, start, lines in _ranges_of(batch):
                at = found.setdefault((file, start), [0, 0, 0])
                own = _quotes(lines, quote)
                before = (at[0] + np.cumsum(own) - own) % 2
                at[0] += int(own.sum())
                at[1] += int((before == 0).sum())
                at[2] += int((before == 1).sum())
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found]), pa.array([k[1] for k in found]), *[pa.array([v[i] for v in found.values()]) for i in range(3)]], ["file", "start", "quotes", "even", "odd"])

    return run


def _numbered(quote: str, states):
    """Every line with its record and its place in the file."""

    def run(batches):
        at: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for file, start, lines in _ranges_of(batch):
                inside, records = states.value[file, start]
                here = at.setdefault((file, start), [inside, records, 0])
                own = _quotes(lines, quote)
                before = (here[0] + np.cumsum(own) - own) % 2
                record = here[1] + np.cumsum(before == 0)
                after = (before + own) % 2
                # a line alone is a record if it starts and ends outside quotes
                several = (before == 1) | (after == 1)
                place = start + here[2] + np.arange(len(own))
                here[0], here[1], here[2] = int(after[-1]), int(record[-1]), here[2] + len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(own)), pa.array(record), pa.array(place), pa.array(several), lines], ["file", "record", "place", "several", "line"])

    return run


def quoted_records(spark: SparkSession, path: str, encoding: str = "UTF-8", quote: str = '"') -> DataFrame:
    """(file, record, text): every record of every file, numbered from 1 in each. ``encoding`` is one of ``ENCODINGS``, where a line end is one byte."""
    value = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)  # the text reader keeps bytes as they are
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), value.alias("line"))
    ranges = rows.mapInArrow(_tally(quote), RANGES)
    so_far = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = ranges.withColumn("inside", F.coalesce(F.sum("quotes").over(so_far), F.lit(0)) % 2)
    state = state.withColumn("own", F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd")))
    state = state.withColumn("records", F.coalesce(F.sum("own").over(so_far), F.lit(0)))
    # a row per byte range of the input, as the scheduler holds them too
    states = spark.sparkContext.broadcast({(r.file, r.start): (r.inside, r.records) for r in state.collect()})
    placed = rows.mapInArrow(_numbered(quote, states), LINES)
    alone = placed.filter(~F.col("several")).select("file", "record", F.regexp_replace("line", "\r$", "").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("place", "line")))
    joined = F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["line"]), "\n"), "\r$", "")
    several = placed.filter("several").groupBy("file", "record").agg(joined.alias("text"))
    return alone.unionByName(several).filter(F.length("text") > 0)


def read_quoted_csv(spark: SparkSession, path: str, schema: str | T.StructType, encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """CSV with quoted line ends as a table of ``schema``; the first record of each file is its header."""
    records = quoted_records(spark, path, encoding)
    if header:
        records = records.filter("record > 1")
    ddl = schema if isinstance(schema, str) else schema.toDDL() if hasattr(schema, "toDDL") else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    # empty cells are NULL, as in the reader of whole files
    parsed = F.from_csv("text", ddl, {"quote": '"', "escape": '"', "multiLine": "true"})
    return records.select(parsed.alias("row")).select("row.*")
