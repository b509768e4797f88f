"""Seven-dimension quality score: pure arithmetic over a measured profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import constants as K
from tablewright.operators.profile import TableProfile, rows_frame

DAY = 86400


def grade_of(score: Column, floors: list[tuple[float, str]] = K.GRADE_FLOORS) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for floor, grade in floors:
        out = out.when(score >= floor, grade)
    return out.otherwise("F")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, rounded down."""
    return F.floor((later.cast("double") - earlier.cast("double")) / DAY)


def named_like(words: list[str]) -> Column:
    low = F.lower("column_name")
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))


def _penalties(p: TableProfile, as_of: str) -> DataFrame:
    c = F.col
    text, number = (c("kind") == "text") & (c("present") > 0), c("kind") == "numeric"
    numeric_ratio, mark_ratio = c("numeric_like") / c("present"), c("references") / c("present")
    currency_ratio = c("currency") / c("present")
    inconsistent = (
        F.when(c("distinct") > c("distinct_norm"), (c("distinct") - c("distinct_norm")) / c("distinct") * 30).otherwise(0.0)
        + c("edge_space") / c("present") * 15
    )
    mistyped = (
        F.when(numeric_ratio > 0.5, numeric_ratio * 25).otherwise(0.0)
        + F.when(mark_ratio > 0.1, mark_ratio * 20).otherwise(0.0)
        + F.when(currency_ratio > 0.3, currency_ratio * 15).otherwise(0.0)
    )
    flat = F.when(number & (c("std") < 0.001) & (c("present") > 0), 10.0).when(
        text & (c("distinct") == 1) & (c("present") > 5), 5.0)
    dated = ~number & named_like(K.FRESHNESS_NAMES) & (c("dates") > c("rows") * 0.5)
    newest = F.min(F.when(dated, F.struct("position", "last_date")))["last_date"]
    return p.frame().agg(
        (F.sum("missing") / F.greatest(F.sum("rows"), F.lit(1)) * 250).alias("completeness"),
        F.lit(p.duplicates / max(p.rows, 1) * 500).alias("uniqueness"),
        F.sum(F.when(text, inconsistent)).alias("consistency"),
        F.sum(F.when(text, mistyped)).alias("type_correctness"),
        F.sum(F.when(number & (c("present") > 10) & (c("q3") > c("q1")), c("extremes") / c("present") * 100)).alias("validity"),
        F.sum(flat).alias("accuracy"),
        days_between(F.lit(as_of).cast("timestamp"), newest).alias("age"),
    )


def dimension_scores(p: TableProfile, as_of: str) -> DataFrame:
    """(dimension, score, weight), scores unrounded. ``as_of`` is the date freshness is judged at."""
    age = F.col("age")
    timeliness = F.when(age > 730, F.greatest(F.lit(50.0), 90 - F.least(age / 365, F.lit(5.0)) * 8)).otherwise(90.0)
    cells = []
    for i, (name, weight) in enumerate(K.QUALITY_WEIGHTS.items()):
        score = timeliness if name == "timeliness" else F.greatest(F.lit(0.0), 100 - F.coalesce(F.col(name), F.lit(0.0)))
        cells.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("dimension"), score.alias("score"), F.lit(weight).alias("weight")))
    return _penalties(p, as_of).select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def dimensions(p: TableProfile, as_of: str) -> DataFrame:
    return dimension_scores(p, as_of).select("dimension", F.round("score", 1).alias("score"), "weight")


def quality_score(p: TableProfile, as_of: str) -> DataFrame:
    overall = F.sum(F.col("score") * F.col("weight"))
    return dimension_scores(p, as_of).agg(F.round(overall, 1).alias("overall"), grade_of(overall).alias("grade"))


def catalogue_score(p: TableProfile, as_of: str) -> DataFrame:
    """The same dimensions under the alternative published weights and grades."""
    weight = F.create_map(*[F.lit(x) for kv in K.CATALOGUE_WEIGHTS.items() for x in kv])[F.col("dimension")]
    overall = F.sum(F.col("score") * weight)
    return dimension_scores(p, as_of).agg(
        F.round(overall, 1).alias("overall"), grade_of(overall, K.CATALOGUE_GRADE_FLOORS).alias("grade"))


def type_issues(p: TableProfile) -> DataFrame:
    """Text columns that hold numbers, reference marks or currency."""
    c = F.col
    rules = [("numeric_as_string", "numeric_like", 0.5), ("embedded_references", "references", 0.1),
             ("unparsed_currency", "currency", 0.3)]
    cells = [F.struct(F.lit(issue).alias("issue"), (c(count) / c("present")).alias("ratio"), F.lit(limit).alias("limit"))
             for issue, count, limit in rules]
    return (
        p.frame().filter("kind = 'text' AND present > 0")
        .select("column_name", F.explode(F.array(*cells)).alias("cell")).select("column_name", "cell.*")
        .filter(c("ratio") > c("limit"))
        .select("column_name", "issue", F.round("ratio", 2).alias("ratio"))
    )


def benchmark_compare(p: TableProfile, as_of: str) -> DataFrame:
    """Four headline numbers against industry expectations."""
    missing = sum(m["missing"] for m in p.metrics) * 100.0 / max(p.rows * p.cols, 1)
    facts = rows_frame(p.spark, [{"missing": missing, "duplicate": p.duplicates * 100.0 / max(p.rows, 1)}],
                       "missing double, duplicate double")
    scores = dimension_scores(p, as_of).agg(
        F.max(F.when(F.col("dimension") == "completeness", F.col("score"))).alias("completeness"),
        F.sum(F.col("score") * F.col("weight")).alias("overall"))
    measured = facts.first().asDict() | scores.first().asDict()
    rows = [
        {"metric": "Missing Value Rate", "value": measured["missing"], "industry": 3.0, "high": False},
        {"metric": "Duplicate Rate", "value": measured["duplicate"], "industry": 1.0, "high": False},
        {"metric": "Completeness Score", "value": measured["completeness"], "industry": 85.0, "high": True},
        {"metric": "Overall Health", "value": measured["overall"], "industry": 80.0, "high": True},
    ]
    frame = rows_frame(p.spark, rows, "metric string, value double, industry double, high boolean")
    digits = F.when(F.col("high"), F.round("value", 1)).otherwise(F.round("value", 2))
    good = F.when(F.col("high"), digits >= F.col("industry")).otherwise(digits <= F.col("industry"))
    return frame.select(
        "metric", digits.alias("yours"), "industry", F.when(good, "success").otherwise("warning").alias("status"),
        F.when(~good & F.col("high"), F.round(F.col("industry") - digits)).otherwise(0.0).alias("points_below"))


def sector_benchmark_grade(p: TableProfile, as_of: str, sector: str = "general") -> DataFrame:
    """Completeness, uniqueness, consistency and age in days against the sector's bands."""
    scores = {r.dimension: r.score for r in dimension_scores(p, as_of).collect()}
    cells = sum(m["missing"] for m in p.metrics) / max(p.rows * p.cols, 1)
    dated = [m["last_date"] for m in p.metrics if m.get("last_date") is not None and m["kind"] != "numeric"]
    age = None
    if dated:
        age = p.spark.range(1).select(days_between(F.lit(as_of).cast("timestamp"), F.lit(max(dated))).cast("double").alias("age")).first().age
    values = {"completeness": 1 - cells, "uniqueness": 1 - p.duplicates / max(p.rows, 1),
              "consistency": scores["consistency"] / 100, "timeliness_days": age}
    rows = []
    for measure_name, value in values.items():
        bands = K.SECTOR_BANDS[measure_name]
        e, g, a, w = bands.get(sector, bands["general"])
        rows.append({"measure": measure_name, "value": value, "excellent": e, "good": g, "acceptable": a, "poor": w})
    frame = rows_frame(p.spark, rows, "measure string, value double, excellent double, good double, acceptable double, poor double")
    low = F.col("measure") == "timeliness_days"

    def reaches(band: str) -> Column:
        return F.when(low, F.col("value") <= F.col(band)).otherwise(F.col("value") >= F.col(band))

    grade = F.when(F.col("value").isNull(), "not measured")
    for band in ("excellent", "good", "acceptable", "poor"):
        grade = grade.when(reaches(band), band)
    return frame.select("measure", F.round("value", 4).alias("value"), grade.otherwise("failing").alias("grade"))
