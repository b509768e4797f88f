"""Preprocessing recommendations and sector detection: rules over metadata and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import constants as K
from tablewright.operators.profile import TableProfile, cardinality_class, distribution_shape
from tablewright.operators.quality import named_like


def _rated(p: TableProfile) -> DataFrame:
    c = F.col
    return p.frame().select(
        "column_name", "position", "kind", "distinct",
        F.round(c("missing") * 100.0 / c("rows"), 2).alias("missing_pct"),
        cardinality_class(c("distinct"), c("rows")).alias("cardinality"),
        F.round("skewness", 3).alias("skewness"),
        F.round(c("outliers") * 100.0 / c("present"), 2).alias("outlier_pct"),
        distribution_shape(c("skewness")).alias("distribution"))


def recommend_imputation(p: TableProfile) -> DataFrame:
    c = F.col
    number = c("kind") == "numeric"
    few = c("cardinality").isin("Low", "Binary", "Moderate")
    skewed = F.abs(F.coalesce(c("skewness"), F.lit(0.0))) > 1
    strategy = (
        F.when(c("missing_pct") > 50, "consider_dropping").when(number & skewed, "median").when(number, "mean")
        .when(few, "mode").otherwise("add_unknown"))
    confidence = (
        F.when(c("missing_pct") > 50, 85).when(number & skewed, 92).when(number, 88).when(few, 86).otherwise(80))
    return _rated(p).filter("missing_pct > 0").select(
        "column_name", F.lit("missing_value").alias("type"), strategy.alias("strategy"), confidence.alias("confidence"))


def recommend_encoding(p: TableProfile) -> DataFrame:
    c = F.col
    binary = c("cardinality") == "Binary"
    strategy = (
        F.when(binary, "label_encoding").when(c("distinct") <= 10, "one_hot")
        .when(c("distinct") <= 30, "target_encoding").otherwise("hash_encoding"))
    confidence = F.when(binary, 95).when(c("distinct") <= 10, 90).when(c("distinct") <= 30, 82).otherwise(72)
    return _rated(p).filter("kind = 'text' AND cardinality NOT IN ('ID', 'High')").select(
        "column_name", F.lit("encoding").alias("type"), strategy.alias("strategy"), confidence.alias("confidence"))


def recommend_scaling(p: TableProfile) -> DataFrame:
    c = F.col
    strategy = (
        F.when(c("outlier_pct") > 3, "robust_scaler").when(c("distribution") == "right_skewed", "log_transform_then_standard")
        .otherwise("standard_scaler"))
    confidence = F.when(c("outlier_pct") > 3, 92).when(c("distribution") == "right_skewed", 86).otherwise(90)
    return _rated(p).filter("kind = 'numeric' AND cardinality NOT IN ('ID', 'Binary')").select(
        "column_name", F.lit("scaling").alias("type"), strategy.alias("strategy"), confidence.alias("confidence"))


def recommend_features(p: TableProfile) -> DataFrame:
    dated, priced = named_like(K.DATE_PART_NAMES), named_like(K.SEGMENT_NAMES)
    return _rated(p).filter(dated | priced).select(
        "column_name", F.lit("feature_engineering").alias("type"),
        F.when(dated, "date_decomposition").otherwise("binning").alias("strategy"),
        F.when(dated, 88).otherwise(78).alias("confidence"))


def recommend_all(p: TableProfile) -> DataFrame:
    out = recommend_imputation(p)
    for part in (recommend_encoding(p), recommend_scaling(p), recommend_features(p)):
        out = out.unionByName(part)
    return out


def detect_sector(columns: DataFrame, custom: dict | None = None) -> DataFrame:
    """Business sector of every table in a catalogue of (table_name, column_name).

    Each column name is tested against the keyword list inside its row, so a catalogue of any
    size needs no join: (table, sector, keyword) hits are made distinct and counted.
    """
    sectors = {**K.SECTORS, **(custom or {})}
    words = F.array(*[
        F.struct(F.lit(s).alias("sector"), F.lit(name).alias("sector_name"), F.lit(float(weight)).alias("weight"),
                 F.lit(len(ws)).alias("size"), F.lit(i).alias("place"), F.lit(w).alias("word"))
        for i, (s, (name, weight, ws)) in enumerate(sectors.items()) for w in ws])
    plain = F.replace(F.lower("column_name"), F.lit(" "), F.lit("_"))
    hits = (
        columns.select("table_name", plain.alias("plain"))
        .select("table_name", F.explode_outer(F.filter(words, lambda w: F.col("plain").contains(w["word"]))).alias("hit"))
        .select("table_name", "hit.*")
    )
    scored = hits.groupBy("table_name", "sector", "sector_name", "weight", "size", "place").agg(F.count_distinct("word").alias("matches"))
    score = F.coalesce(F.col("matches") * F.col("weight") / F.col("size") * 100, F.lit(0.0))
    best = F.max(F.struct(score.alias("score"), (-F.col("place")).alias("earlier"), "sector", "sector_name", "matches")).alias("best")
    found = F.col("best.score") >= 5
    return scored.groupBy("table_name").agg(best).select(
        "table_name",
        F.when(found, F.col("best.sector")).otherwise("general").alias("sector_id"),
        F.when(found, F.col("best.sector_name")).otherwise("General Business").alias("sector_name"),
        F.when(found, F.least(F.round("best.score", 1), F.lit(99.0))).otherwise(50.0).alias("confidence"),
        F.when(found, F.col("best.matches")).otherwise(0).cast("long").alias("matched_patterns"))
