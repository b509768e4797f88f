"""Data threats: rules over a measured profile. No rule scans the table again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import constants as K
from tablewright.operators.profile import TableProfile, rows_frame
from tablewright.operators.quality import days_between, named_like


def _text(x: Column) -> Column:
    return x.cast("string")


def _pct(part: str, whole: str, digits: int = 2) -> Column:
    return F.round(F.try_divide(F.col(part) * 100.0, F.col(whole)), digits)


def _threat(frame: DataFrame, id: Column, severity: Column, title: Column, column: Column, category: str,
            impact: Column, confidence: Column, actions: list[str]) -> DataFrame:
    return frame.select(
        id.alias("id"), severity.alias("severity"), title.alias("title"), column.alias("column_name"),
        F.lit(category).alias("category"), impact.alias("impact"), confidence.cast("int").alias("confidence"),
        F.array(*[F.lit(a) for a in actions]).alias("actions"))


def missing_threats(p: TableProfile) -> DataFrame:
    name, pct = F.col("column_name"), _pct("missing", "rows")
    rated = p.frame().withColumn("pct", pct).filter("missing > 0 AND pct > 0")
    identifier = named_like(K.IDENTIFIER_NAMES)
    pct = F.col("pct")
    return _threat(
        rated, F.concat(F.lit("mv_"), name),
        F.when(identifier | (pct > 30), "critical").when(pct > 5, "warning").otherwise("low"),
        F.concat(F.lit("Missing values in "), name, F.lit(" ("), _text(pct), F.lit("%)")), name, "Data Quality",
        F.concat(_text(F.col("missing")), F.lit(" rows lack this value")),
        F.when(identifier, 99).when(pct > 30, 90).when(pct > 5, 85).otherwise(88),
        ["Trace the gap to its source", "Impute or flag what cannot be recovered"])


def duplicate_threats(p: TableProfile) -> DataFrame:
    frame = rows_frame(p.spark, [{"copies": p.duplicates, "rows": p.rows}], "copies long, rows long")
    pct = _pct("copies", "rows")
    return _threat(
        frame.filter("copies > 0"), F.lit("dup_exact"), F.when(pct > 5, "critical").when(pct > 1, "warning").otherwise("low"),
        F.concat(F.lit("Duplicate rows ("), _text(F.col("copies")), F.lit(", "), _text(pct), F.lit("%)")), F.lit("All columns"),
        "Data Quality", F.lit("Totals and counts may be inflated"), F.lit(95), ["Review the groups", "Keep one row of each"])


def inconsistent_category_threats(p: TableProfile, limit: int = 100) -> DataFrame:
    """Text columns of at most ``limit`` values that differ in case; ``insights.category_summary`` names the wider ones."""
    name, extra = F.col("column_name"), F.col("distinct") - F.col("distinct_lower")
    found = p.frame().filter("kind = 'text' AND distinct > distinct_lower").filter(F.col("distinct") <= limit)
    return _threat(
        found, F.concat(F.lit("inc_"), name), F.when(extra > 3, "warning").otherwise("low"),
        F.concat(F.lit("Inconsistent categories in "), name), name, "Data Quality",
        F.concat(_text(F.col("distinct")), F.lit(" spellings of "), _text(F.col("distinct_lower")), F.lit(" categories")),
        F.lit(94), ["Standardize case", "Merge variants"])


def mixed_type_threats(p: TableProfile) -> DataFrame:
    name, pct = F.col("column_name"), F.col("numeric_like") * 100.0 / F.col("present")
    years = F.lower(name).contains("year") & (F.col("year_like") / F.col("present") > 0.8)
    found = p.frame().filter("kind = 'text' AND present > 0").filter((pct > 20) & (pct < 95) & ~years)
    return _threat(
        found, F.concat(F.lit("mt_"), name), F.lit("critical"), F.concat(F.lit("Mixed data types in "), name), name, "Data Quality",
        F.concat(_text(F.round(pct, 1)), F.lit("% of the values read as numbers")), F.lit(91),
        ["Find the dominant type", "Convert or null the rest"])


def outlier_threats(p: TableProfile) -> DataFrame:
    name, pct = F.col("column_name"), _pct("outliers", "present")
    return _threat(
        p.frame().filter("outliers > 0"), F.concat(F.lit("out_"), name), F.when(pct > 1, "warning").otherwise("low"),
        F.concat(F.lit("Outliers in "), name, F.lit(" ("), _text(F.col("outliers")), F.lit(" values, "), _text(pct), F.lit("%)")),
        name, "Data Quality",
        F.concat(F.lit("outside ["), _text(F.round("lower", 2)), F.lit(", "), _text(F.round("upper", 2)), F.lit("]")),
        F.lit(88), ["Check whether they are errors", "Winsorize or scale robustly"])


def neighbour_threats(p: TableProfile, found: list[dict]) -> DataFrame:
    """Threats from measured nearest-neighbour outliers (column_name, outliers, present)."""
    frame = rows_frame(p.spark, [f for f in found if f["outliers"]], "column_name string, outliers long, present long")
    name, pct = F.col("column_name"), _pct("outliers", "present", 1)
    return _threat(
        frame, F.concat(F.lit("knn_"), name), F.when(pct > 1, "warning").otherwise("low"),
        F.concat(F.lit("Isolated values in "), name, F.lit(" ("), _text(F.col("outliers")), F.lit(")")), name, "Anomaly Detection",
        F.concat(_text(pct), F.lit("% lie far from their neighbours")), F.lit(92), ["Review the values"])


def collinearity_threats(p: TableProfile) -> DataFrame:
    r = F.round("r", 3)
    found = p.pair_frame().filter(F.abs(F.col("r")) > 0.7).filter(F.abs(r) > 0.85)
    strong = F.abs(r) > 0.95
    return _threat(
        found, F.concat_ws("_", F.lit("corr"), "col1", "col2"), F.when(strong, "critical").otherwise("warning"),
        F.concat(F.lit("Correlated features (r="), _text(r), F.lit(")")), F.concat_ws(" ↔ ", "col1", "col2"), "ML Risk",
        F.lit("The two columns carry nearly the same information"), F.when(strong, 97).otherwise(85),
        ["Check for leakage", "Drop one of the pair"])


def pii_threats(p: TableProfile) -> DataFrame:
    cells = [F.struct(F.lit(k).alias("pii"), F.lit(K.PII_LABELS[k]).alias("label"), (F.col(k) * 100.0 / F.col("present")).alias("pct"))
             for k in K.PII_PATTERNS]
    found = (
        p.frame().filter("kind = 'text' AND present > 0")
        .select("column_name", F.explode(F.array(*cells)).alias("cell")).select("column_name", "cell.*").filter("pct > 30"))
    name = F.col("column_name")
    return _threat(
        found, F.concat_ws("_", F.lit("pii"), "pii", name), F.lit("critical"),
        F.concat(F.col("label"), F.lit(" in "), name), name, "Privacy",
        F.concat(_text(F.round("pct", 0)), F.lit("% of the values match")), F.lit(96), ["Hash or tokenize", "Drop if not needed"])


def stale_threats(p: TableProfile, as_of: str) -> DataFrame:
    name = F.col("column_name")
    age = days_between(F.lit(as_of).cast("timestamp"), F.col("last_date"))
    span = days_between(F.col("last_date"), F.col("first_date"))
    found = p.frame().filter("kind <> 'numeric' AND dates > 10").filter(named_like(K.FRESHNESS_NAMES) & (span > 90) & (age > 90))
    return _threat(
        found, F.concat(F.lit("stale_"), name), F.lit("warning"),
        F.concat(F.lit("Stale data ("), _text(age), F.lit(" days old)")), name, "Business",
        F.lit("Decisions may rest on outdated rows"), F.lit(82), ["Check the feed", "Refresh the table"])


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).when(severity == "low", 2).otherwise(3)


def all_threats(p: TableProfile, as_of: str, neighbours: list[dict] | None = None) -> DataFrame:
    parts = [missing_threats(p), duplicate_threats(p), inconsistent_category_threats(p), mixed_type_threats(p),
             outlier_threats(p), collinearity_threats(p), pii_threats(p), stale_threats(p, as_of)]
    if neighbours:
        parts.append(neighbour_threats(p, neighbours))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rank_threats(p: TableProfile, as_of: str, neighbours: list[dict] | None = None) -> DataFrame:
    """All threats, worst first."""
    return all_threats(p, as_of, neighbours).orderBy(severity_rank(F.col("severity")), F.desc("confidence"), "id")


def threat_counts(p: TableProfile, as_of: str) -> DataFrame:
    s = F.col("severity")
    return all_threats(p, as_of).agg(
        F.count("*").alias("total"), F.count_if(s == "critical").alias("critical"),
        F.count_if(s == "warning").alias("warning"), F.count_if(s == "low").alias("low"))
