"""Writing tables, alone or with their quality numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.profile import TableProfile, rows_frame
from tablewright.operators.quality import dimension_scores, quality_score


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def quality_card(p: TableProfile, as_of: str, metadata: dict | None = None) -> DataFrame:
    """(metric, value) facts of a table."""
    missing = sum(m["missing"] for m in p.metrics)
    facts = {"rows": p.rows, "columns": p.cols, "missing_cells": missing, "duplicate_rows": p.duplicates, **(metadata or {})}
    base = rows_frame(p.spark, [{"metric": k, "value": str(v)} for k, v in facts.items()], "metric string, value string")
    score = quality_score(p, as_of).select(F.explode(F.create_map(F.lit("quality_score"), F.col("overall").cast("string"), F.lit("grade"), F.col("grade"))).alias("metric", "value"))
    dims = dimension_scores(p, as_of).select(F.col("dimension").alias("metric"), F.round("score", 1).cast("string").alias("value"))
    return base.unionByName(score).unionByName(dims)


def write_with_quality_metadata(df: DataFrame, p: TableProfile, path: str, as_of: str, metadata: dict | None = None, mode: str = "errorifexists") -> None:
    """Data as parquet under ``path/data`` and its (metric, value) card under ``path/quality``."""
    df.write.mode(mode).parquet(f"{path}/data")
    quality_card(p, as_of, metadata).coalesce(1).write.mode(mode).parquet(f"{path}/quality")
