"""A decided cleaning plan on a stream, and windowed quality counts.

A plan holds only row-local expressions, so the same ``select`` that cleaned a batch cleans a
stream; no state is kept. Quality counts are windowed by event time with a watermark, so state
stays as large as the open windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tablewright.functions.text import col
from tablewright.plans.cleaning import CleaningPlan


def read_files(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def clean_stream(stream: DataFrame, plan: CleaningPlan) -> DataFrame:
    return plan.apply(stream)


def windowed_quality(stream: DataFrame, ts: str, checks: dict[str, str], window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows and rows breaking each check per event-time window."""
    return (
        stream.withWatermark(ts, late).groupBy(F.window(col(ts), window).alias("window"))
        .agg(F.count("*").alias("rows"), *[F.count_if(F.expr(e)).alias(n) for n, e in checks.items()])
        .select(F.col("window.start").alias("window_start"), "rows", *checks))


def write_clean(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Parquet sink with its own checkpoint; the caller starts it."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
