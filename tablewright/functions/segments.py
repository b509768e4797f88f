"""Splitting ordered work into even pieces, so that no key or series lands in one task.

Rows are range-partitioned by the order and a second column that splits its ties, and the number of the partition becomes a column.
What crosses an edge is a few rows per piece and stays a DataFrame. The pieces are written once: a second look must find the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.text import col
from tablewright.session import cut_lineage


SEGMENT_ROWS = 1 << 18


def pieces_for(df: DataFrame) -> int:
    """As many pieces as keep each to about ``SEGMENT_ROWS`` rows, and the cores of a small table busy."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SEGMENT_ROWS))


def segmented(df: DataFrame, order: list[str], segments: int | None = None) -> DataFrame:
    """``df`` with ``__segment``, rising along ``order``; the number of pieces follows the number of rows, unless told."""
    pieces = segments or pieces_for(df)
    return cut_lineage(df.repartitionByRange(pieces, *[col(c) for c in order]).withColumn("__segment", F.spark_partition_id()))


def haloed(df: DataFrame, keys: list[str], order: str, tie: str, reach: int, segments: int | None = None) -> DataFrame:
    """Rows with their segment, plus copies of the rows up to ``reach`` away on either side.

    A window partitioned by keys and ``__segment`` then sees the true neighbours of every row
    where ``__own`` holds. Only the first and last ``reach`` rows of each (key, segment) are
    considered for copying, so the window that places them stays small.
    """
    placed = segmented(df, [order, tie], segments).withColumn("__own", F.lit(True))
    group = [col(k) for k in keys] + [F.col("__segment")]
    up = Window.partitionBy(*group).orderBy(col(order), col(tie))
    down = Window.partitionBy(*group).orderBy(F.desc(order), F.desc(tie))
    first = placed.withColumn("__rank", F.row_number().over(up)).filter(F.col("__rank") <= reach).drop("__rank")
    last = placed.withColumn("__rank", F.row_number().over(down)).filter(F.col("__rank") <= reach).drop("__rank")
    ends = first.unionByName(last).dropDuplicates(list(dict.fromkeys([*keys, order, tie])))
    along = Window.partitionBy(*([col(k) for k in keys] or [F.lit(0)])).orderBy(col(order), col(tie))  # a few rows per segment
    near = F.array(*[shift("__segment", i).over(along) for i in range(1, reach + 1) for shift in (F.lag, F.lead)])
    targets = F.array_distinct(F.filter("__near", lambda s: s.isNotNull() & (s != F.col("__segment"))))
    copies = ends.withColumn("__near", near).withColumn("__to", F.explode(targets)).drop("__near").withColumn("__segment", F.col("__to")).withColumn("__own", F.lit(False)).drop("__to")
    return placed.unionByName(copies)


def cumulative(counts: DataFrame, value: str, amounts: list[str], segments: int | None = None) -> DataFrame:
    """Running totals of amounts in value order, over one row per distinct value.

    Totals run inside the segments; what lies before each segment comes from one row per segment.
    """
    placed = segmented(counts, [value], segments)
    before = Window.partitionBy(F.lit(0)).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__segment").agg(*[F.sum(a).alias(f"__all_{a}") for a in amounts])
    offsets = totals.select("__segment", *[F.coalesce(F.sum(f"__all_{a}").over(before), F.lit(0)).alias(f"__before_{a}") for a in amounts])
    inside = Window.partitionBy("__segment").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumns({f"__upto_{a}": F.sum(a).over(inside) for a in amounts}).join(offsets, "__segment")
    return running.select(*[col(c) for c in counts.columns], *[(F.col(f"__upto_{a}") + F.col(f"__before_{a}")).alias(f"upto_{a}") for a in amounts])
