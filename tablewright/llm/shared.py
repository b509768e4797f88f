"""Small helpers: the shared folder, stages written to it, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local master may go without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as a table of the shared folder and read back: computed once, safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that the edges (a, b) of longs connect a node with.

    Every round links each node to the smallest node near it and cuts the lineage with a written table. The
    number of rounds grows with the logarithm of the longest path. No node's neighbours are ever gathered:
    minima are pre-aggregated, joins are plain ones, which AQE splits when a key is hot.
    """
    e = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # every larger neighbour of a node now hangs on the node's smallest neighbour
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("v"), "m").distinct()
        # and every smaller one, with the node itself
        low = large.groupBy("v").agg(F.min("m").alias("k"))
        small = large.join(low.withColumnRenamed("v", "w"), F.col("v") == F.col("w"))
        new = small.select(F.col("m").alias("b"), F.col("k").alias("a")).union(small.select(F.col("v").alias("b"), F.col("k").alias("a")))
        new = stored(new.where("a <> b").select("a", "b").distinct(), "edges")
        # a forest of stars: no node is both a centre and a leaf, and every leaf has one centre
        centres, leaves = new.select("a").distinct(), new.groupBy("b").count()
        e = new
        if leaves.where("count > 1").isEmpty() and centres.join(leaves, F.col("a") == F.col("b"), "left_semi").isEmpty():
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(centres.select(F.col("a").alias("node"), F.col("a").alias("component")))
    raise RuntimeError("components did not settle")
