"""Standard analytical questions about a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import constants as K
from tablewright.functions.text import col, name_has
from tablewright.operators import profile as P
from tablewright.operators.quality import dimension_scores, named_like, quality_score
from tablewright.operators.threats import rank_threats, threat_counts


def format_money(x: Column) -> Column:
    """Rupee amounts in crore, lakh or thousand."""
    size = F.abs(x)

    def shown(amount: Column, digits: int, unit: str) -> Column:
        plain = F.replace(F.format_number(amount, digits), F.lit(","), F.lit(""))
        return F.concat(F.lit("₹"), plain, F.lit(unit))

    return (
        F.when(size >= 1e7, shown(x / 1e7, 2, "Cr")).when(size >= 1e5, shown(x / 1e5, 2, "L"))
        .when(size >= 1e3, shown(x / 1e3, 1, "K")).otherwise(shown(x, 2, "")))


def kpis(df: DataFrame) -> DataFrame:
    stats = P.measure_numbers(df)
    raw = P.rows_frame(df.sparkSession, [s for s in stats.values() if s["count"]],
                       "column_name string, total double, mean double, median double, std double, min double, max double")
    financial = named_like(K.MONEY_NAMES)
    return raw.select(
        "column_name", *[F.round(c, 2).alias(c) for c in ("total", "mean", "median", "std", "min", "max")],
        F.when(financial, "financial").otherwise("numeric").alias("kpi_type"),
        F.when(financial, format_money(F.col("total"))).alias("formatted_total"))


def few_valued_columns(df: DataFrame, limit: int) -> list[str]:
    """Text columns with 1 to ``limit`` distinct values."""
    return [r.column_name for r in P.text_distincts(df).filter(F.col("distinct").between(1, limit)).collect()]


def category_distribution(df: DataFrame, k: int = 10, limit: int = 50) -> DataFrame:
    """Top values of every text column that has few values."""
    keep = few_valued_columns(df, limit)
    if not keep:
        return df.sparkSession.createDataFrame([], P.TOP_SCHEMA)
    ordered = [c for c in P.text_columns(df) if c in keep]
    return P.restore_long_values(df.select(*[col(c) for c in ordered]), P.top_values(df, ordered, k))


def category_summary(df: DataFrame, limit: int = 50) -> DataFrame:
    """(column_name, distinct, mode, mode_count, listed) of every text column that has values.

    ``listed`` tells whether the column has at most ``limit`` values and so appears in ``category_distribution``; the others are named here, not dropped unseen.
    """
    columns = P.text_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, distinct long, mode string, mode_count long, listed boolean")
    best = P.restore_long_values(df, P.top_values(df, columns, 1)).select("column_name", F.col("value").alias("mode"), F.col("n").alias("mode_count"))
    counts = P.text_distincts(df).select("column_name", "distinct")
    return counts.join(best, "column_name").select("column_name", "distinct", "mode", "mode_count", (F.col("distinct") <= limit).alias("listed"))


def extreme_values(df: DataFrame) -> DataFrame:
    stats = [s for s in P.measure_numbers(df).values() if s["count"] >= 20 and s["extremes"]]
    raw = P.rows_frame(df.sparkSession, stats, "column_name string, count long, extremes long, min_extreme double, max_extreme double, median double")
    return raw.select(
        "column_name", F.col("extremes").alias("extreme_count"), P.share(F.col("extremes"), F.col("count")).alias("extreme_pct"),
        F.round("min_extreme", 2).alias("min_extreme"), F.round("max_extreme", 2).alias("max_extreme"),
        F.round("median", 2).alias("median_value"))


def default_measure(df: DataFrame) -> str | None:
    numbers = P.numeric_columns(df)
    return next((c for c in numbers if name_has(c, K.MEASURE_NAMES)), numbers[-1] if numbers else None)


def _n_by_group(df: DataFrame, category: str | None, measure: str | None, n: int, ascending: bool) -> DataFrame:
    category = category or next(iter(P.text_columns(df)), None)
    measure = measure or default_measure(df)
    if category is None or measure is None:  # nothing to group or to sum
        return df.sparkSession.createDataFrame([], "category string, total double")
    total = F.round(F.sum(P.as_double(df, measure)), 2)
    grouped = df.filter(col(category).isNotNull()).groupBy(col(category).alias("category")).agg(total.alias("total"))
    return grouped.orderBy(F.asc("total") if ascending else F.desc("total"), "category").limit(n)


def top_n_by_group(df: DataFrame, category: str | None = None, measure: str | None = None, n: int = 10) -> DataFrame:
    return _n_by_group(df, category, measure, n, ascending=False)


def bottom_n_by_group(df: DataFrame, category: str | None = None, measure: str | None = None, n: int = 10) -> DataFrame:
    return _n_by_group(df, category, measure, n, ascending=True)


def notable_correlations(df: DataFrame, threshold: float = 0.3, n: int = 8) -> DataFrame:
    size = F.abs(F.col("r"))
    return (
        P.correlations(df).filter(size > threshold).orderBy(F.desc(size), "col1", "col2").limit(n)
        .select("col1", "col2", F.round("r", 2).alias("correlation"),
                F.when(size > 0.7, "Strong").otherwise("Moderate").alias("strength"),
                F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction")))


def describe_column(df: DataFrame, name: str) -> DataFrame:
    """(item, value) facts of one column."""
    only = df.select(col(name))
    spark = df.sparkSession
    missing = P.missing_counts(only).first()
    share_missing = round(missing.missing * 100.0 / max(missing.rows, 1), 1)
    if P.kind_of(df.schema[name].dataType) == "numeric":
        s = P.measure_numbers(only)[name]
        facts = [("count", s["count"]), *[(k, s.get(k)) for k in ("mean", "median", "std", "min", "max")],
                 ("missing", missing.missing), ("missing_pct", share_missing)]
        frame = P.rows_frame(spark, [{"item": k, "value": v} for k, v in facts], "item string, value double")
        return frame.select("item", F.round("value", 2).alias("value"))
    distinct = P.distinct_counts(only).first()["distinct"]
    facts = [{"item": "unique", "value": distinct}, {"item": "missing", "value": missing.missing},
             {"item": "missing_pct", "value": share_missing}]
    frame = P.rows_frame(spark, facts, "item string, value double")
    if distinct <= 30:
        tops = P.restore_long_values(only, P.top_values(only, [name], 10))
        frame = frame.unionByName(tops.select(F.concat(F.lit("value: "), "value").alias("item"), F.col("n").cast("double").alias("value")))
    return frame


def missing_report(df: DataFrame) -> DataFrame:
    """Missing cells per column and their share of all cells."""
    width = len(df.columns)
    return (
        P.missing_counts(df).filter("missing > 0")
        .select("column_name", "missing", P.share(F.col("missing"), F.col("rows"), 1).alias("missing_pct"),
                P.share(F.col("missing"), F.col("rows") * width).alias("share_of_cells"))
        .orderBy(F.desc("missing"), "column_name"))


def outlier_report(df: DataFrame) -> DataFrame:
    stats = [s for s in P.measure_numbers(df).values() if s["count"] >= 10 and s["outliers"]]
    raw = P.rows_frame(df.sparkSession, stats, "column_name string, count long, outliers long, lower double, upper double")
    return raw.select("column_name", "outliers", P.share(F.col("outliers"), F.col("count"), 1).alias("outlier_pct"),
                      F.round("lower", 2).alias("lower_bound"), F.round("upper", 2).alias("upper_bound"))


def priority_fixes(p: P.TableProfile, as_of: str, n: int = 3) -> DataFrame:
    return rank_threats(p, as_of).limit(n).select("id", "severity", "column_name", F.col("actions")[0].alias("first_action"))


def weakest_dimensions(p: P.TableProfile, as_of: str, n: int = 3) -> DataFrame:
    rounded = dimension_scores(p, as_of).withColumn("score", F.round("score", 1))
    return rounded.orderBy("score", "position").limit(n).select("dimension", "score")


def _facts(p: P.TableProfile) -> list[dict]:
    missing = sum(m["missing"] for m in p.metrics)
    return [
        {"section": "size", "item": "rows", "value": p.rows}, {"section": "size", "item": "cols", "value": p.cols},
        {"section": "missing", "item": "cells", "value": missing},
        {"section": "missing", "item": "pct", "value": missing * 100.0 / max(p.rows * p.cols, 1)},
        {"section": "duplicates", "item": "rows", "value": p.duplicates},
    ]


def dataset_summary(p: P.TableProfile) -> DataFrame:
    """Size, gaps, copies and the numeric columns, as (section, item, value)."""
    rows = _facts(p)
    for m in [m for m in p.metrics if m["kind"] == "numeric"]:
        rows += [{"section": m["column_name"], "item": k, "value": m[k]} for k in ("mean", "median", "min", "max")]
    return P.rows_frame(p.spark, rows, "section string, item string, value double").select("section", "item", F.round("value", 2).alias("value"))


def report_facts(p: P.TableProfile, as_of: str) -> DataFrame:
    """The numbers behind an executive report, as (section, item, value)."""
    rows = [{"section": "size", "item": "rows", "value": p.rows}, {"section": "size", "item": "cols", "value": p.cols},
            {"section": "effort", "item": "analyst_hours_saved", "value": max(5, p.rows // 500)}]
    money = [m for m in p.metrics if m["kind"] == "numeric" and m["present"] and name_has(m["column_name"], K.REPORT_MONEY_NAMES)]
    for m in money:
        rows += [{"section": "money", "item": f"{m['column_name']} {k}", "value": m[k]} for k in ("total", "mean", "median")]
    for m in [m for m in p.metrics if m["kind"] == "text"]:
        if 0 < m["distinct"] <= 20:
            rows.append({"section": "category", "item": m["column_name"], "value": m["distinct"]})
            rows += [{"section": "category", "item": f"{m['column_name']} = {t['value']}", "value": t["n"]}
                     for t in p.tops if t["column_name"] == m["column_name"] and t["rank"] <= 3]
    facts = P.rows_frame(p.spark, rows, "section string, item string, value double").select("section", "item", F.round("value", 2).alias("value"))
    score = quality_score(p, as_of).select(F.lit("score").alias("section"), F.concat(F.lit("overall "), "grade").alias("item"), F.col("overall").alias("value"))
    counts = threat_counts(p, as_of).unpivot([], ["total", "critical", "warning"], "item", "value").select(
        F.lit("threats").alias("section"), "item", F.col("value").cast("double").alias("value"))
    dims = dimension_scores(p, as_of).select(F.lit("dimension").alias("section"), F.col("dimension").alias("item"), F.round("score", 1).alias("value"))
    return facts.unionByName(score).unionByName(counts).unionByName(dims)


def histograms(df: DataFrame, columns: list[str] | None = None, bins: int = 30) -> DataFrame:
    """Equal-width histograms; the last bin includes the maximum. Empty bins are left out."""
    columns = P.numeric_columns(df) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, bin int, n long")
    found = P.long_numbers(df, columns).groupBy("column_name").agg(F.min("value").alias("a"), F.max("value").alias("b")).filter("a IS NOT NULL").collect()
    if not found:
        return df.sparkSession.createDataFrame([], "column_name string, bin int, n long")
    spread = {r.column_name: (r.a - 0.5, r.b + 0.5) if r.a == r.b else (r.a, r.b) for r in found}
    cells = [x for c, (low, high) in spread.items() for x in (F.lit(c), P.as_double(df, c), F.lit(float(low)), F.lit(float(high)))]
    a, b, v = F.col("a"), F.col("b"), F.col("value")
    step = (b - a) / bins
    first = F.least(F.floor((v - a) * (F.lit(float(bins)) / (b - a))), F.lit(bins - 1))
    down = F.when(v < a + F.col("bin") * step, 1).otherwise(0)
    up = F.when((F.col("bin") < bins - 1) & (v >= a + (F.col("bin") + 1) * step), 1).otherwise(0)
    return (
        df.select(F.stack(F.lit(len(spread)), *cells).alias("column_name", "value", "a", "b")).filter(v.isNotNull())
        .withColumn("bin", first)
        .withColumn("bin", (F.col("bin") - down + up).cast("int"))
        .groupBy("column_name", "bin").agg(F.count("*").alias("n")))


def correlation_matrix(df: DataFrame) -> DataFrame:
    """Lower triangle: every numeric column against each earlier one."""
    return P.correlations(df).select(F.col("col2").alias("row_column"), F.col("col1").alias("col_column"), F.round("r", 2).alias("r"))


def describe_all(p: P.TableProfile) -> DataFrame:
    number = F.col("kind") == "numeric"
    return p.frame().select(
        "column_name", F.col("present").alias("count"),
        F.when(F.col("kind") == "text", F.col("distinct")).alias("unique"), F.col("mode").alias("top"), F.col("mode_count").alias("freq"),
        *[F.when(number, F.round(c, 2)).alias(a) for c, a in
          (("mean", "mean"), ("std", "std"), ("min", "min"), ("q1", "p25"), ("median", "p50"), ("q3", "p75"), ("max", "max"))])
