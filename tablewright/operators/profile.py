"""Column profiling: fused scans that yield one small row per column.

Per-column numbers are measured over the unpivoted table, grouped by column name. The group key
has as many values as the table has columns and every aggregate combines map-side, so the shuffle
is tiny and the plan does not grow with the table's width.
"""

from __future__ import annotations

import datetime as dt
import math
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import constants as K
from tablewright.functions.dates import parse_date
from tablewright.functions.distincts import distincts, folded_values
from tablewright.functions.quantiles import STATE, Summary, column_facts, merged, read_states, state_rows, summaries
from tablewright.functions.text import bare, col, norm, numeric_looking, strip, value_key
from tablewright.session import cut_lineage

# --------------------------------------------------------------------------- column classes


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "other"


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "numeric")


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "text")


def as_double(df: DataFrame, name: str) -> Column:
    """The column as double with NaN and infinities as NULL."""
    x = col(name).cast("double")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return x


def doubles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Only the numeric columns, as double; the scan reads nothing else."""
    return df.select(*[as_double(df, c).alias(c) for c in (numeric_columns(df) if columns is None else columns)])


def with_nulls(df: DataFrame) -> DataFrame:
    """``df`` with NaN as NULL in float and double columns."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(*[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floating else col(c) for c in df.columns])


def row_digest(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all values of a row and where NULLs stand: a key of 16 bytes for rows of any width."""
    cells = [x for c in df.columns for x in (col(c).isNull(), col(c))]
    return [F.xxhash64(F.lit(seed), *cells).alias(f"__row{seed}") for seed in (1, 2)]


def unpivot(df: DataFrame, columns: list[str], kind: str = "string") -> DataFrame:
    """Long form (column_name, value) of same-typed columns; of no columns, no rows with values of that ``kind``.

    ``stack`` keeps its output in local variables of the generated code, where later stages of
    many expressions still compile.
    """
    if not columns:
        return df.select(F.lit("").alias("column_name"), F.lit(None).cast(kind).alias("value")).filter(F.lit(False))
    cells = [x for c in columns for x in (F.lit(c), col(c))]
    return df.select(F.stack(F.lit(len(columns)), *cells).alias("column_name", "value"))


def spread_out(df: DataFrame) -> DataFrame:
    """Use every core on an input that came in fewer pieces, such as one small file.

    Inputs of cluster size already have more partitions than cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def held(df: DataFrame):
    """The table for several passes: a small one spread over the cores and held in memory.

    Small means fewer partitions than cores, so what is held is bounded by the cores' own
    partitions. A table of cluster size is read again by every pass, which prunes to the columns
    that pass needs. Lost blocks are computed again from the source.
    """
    spread = spread_out(df)
    if spread is df:
        yield df
        return
    spread.persist()
    try:
        yield spread
    finally:
        spread.unpersist()


def long_numbers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = numeric_columns(df) if columns is None else columns
    return unpivot(doubles(df, columns), columns, "double")


def long_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = text_columns(df) if columns is None else columns
    return unpivot(spread_out(df.select(*[col(c) for c in columns])), columns)


def folded_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, value, n): as ``long_text``, with equal values of a stretch of rows folded into one."""
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return long_text(df, columns).withColumn("n", F.lit(1).cast("long"))
    names = F.array(*[F.lit(c) for c in columns])
    return folded_values(spread_out(df.select(*[col(c) for c in columns]))).select(names[F.col("key")].alias("column_name"), "value", "n")


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), digits)


# --------------------------------------------------------------------------- single operators


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, kinds, missing cells and duplicate rows, in one grouped pass."""
    df = with_nulls(df)
    kinds = [kind_of(f.dataType) for f in df.schema.fields]
    missing = sum((col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    width = len(df.columns)
    return (
        df.select(*row_digest(df), missing.alias("missing")).groupBy("__row1", "__row2")
        .agg(F.count("*").alias("copies"), F.sum("missing").alias("missing"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("missing"), F.lit(0)).alias("total_missing"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("total_duplicates"),
        )
        .select(
            "rows",
            F.lit(width).cast("long").alias("cols"),
            *[F.lit(kinds.count(k)).cast("long").alias(f"{k}_columns") for k in ("numeric", "text", "datetime")],
            "total_missing",
            share(F.col("total_missing"), F.col("rows") * width).alias("total_missing_pct"),
            "total_duplicates",
        )
    )


def _per_column(df: DataFrame, columns: list[str], measures: dict) -> DataFrame:
    """One aggregate over the table, turned into one row per column."""
    aggregates = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        aggregates += [f(c).alias(f"{m}_{i}") for m, f in measures.items()]
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col("rows"), *[F.col(f"{m}_{i}").alias(m) for m in measures])
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggregates).select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def missing_counts(df: DataFrame) -> DataFrame:
    counted = _per_column(with_nulls(df), df.columns, {"present": lambda c: F.count(col(c))})
    return counted.select("column_name", "rows", (F.col("rows") - F.col("present")).alias("missing"))


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with missing values, worst first, with a severity."""
    ratio = F.col("missing") / F.col("rows")
    return (
        missing_counts(df)
        .filter("missing > 0")
        .select(
            "column_name",
            "missing",
            share(F.col("missing"), F.col("rows")).alias("missing_pct"),
            F.when(ratio > 0.3, "critical").when(ratio > 0.05, "warning").otherwise("low").alias("severity"),
        )
        .orderBy(F.desc("missing"), "column_name")
    )


def countable_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]


def cardinality_class(distinct: Column, rows: Column) -> Column:
    return (
        F.when(distinct <= 2, "Binary")
        .when(distinct <= 10, "Low")
        .when(distinct <= 50, "Moderate")
        .when(distinct >= rows * 0.9, "ID")
        .otherwise("High")
    )


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column, their share of rows, and the cardinality class.

    ``approximate`` swaps the exact count for a sketch.
    """
    df, countable = with_nulls(df), countable_columns(df)
    if approximate:
        counted = _per_column(df, countable, {"distinct": lambda c: F.approx_count_distinct(col(c))})
    else:
        counted = distincts(df, {c: col(c) for c in countable}).withColumnRenamed("name", "column_name")
    return counted.select(
        "column_name",
        "distinct",
        share(F.col("distinct"), F.greatest(F.col("rows"), F.lit(1))).alias("distinct_pct"),
        cardinality_class(F.col("distinct"), F.col("rows")).alias("cardinality"),
    )


def adjusted_skewness(n: Column, skew: Column) -> Column:
    """Bias-adjusted skewness from the population value; 0 when all values are equal."""
    adjusted = skew * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.when(F.isnan(skew), 0.0).otherwise(adjusted))


def adjusted_kurtosis(n: Column, kurt: Column) -> Column:
    """Bias-adjusted excess kurtosis from the population value; 0 when all values are equal."""
    adjusted = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6)
    return F.when(n >= 4, F.when(F.isnan(kurt), 0.0).otherwise(adjusted))


def moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, total, mean, sample and population deviation, range, adjusted skew and kurtosis."""
    v = F.col("value")
    n = F.col("count").cast("double")
    return (
        long_numbers(df, columns)
        .groupBy("column_name")
        .agg(
            F.count(v).alias("count"),
            F.sum(v).alias("total"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.stddev_pop(v).alias("std_pop"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.skewness(v).alias("g1"),
            F.kurtosis(v).alias("g2"),
        )
        .select(
            "column_name", "count", "total", "mean", "std", "std_pop", "min", "max",
            adjusted_skewness(n, F.col("g1")).alias("skewness"),
            adjusted_kurtosis(n, F.col("g2")).alias("kurtosis"),
        )
    )


def distribution_shape(skewness: Column) -> Column:
    return (
        F.when(skewness.isNull(), "unknown")
        .when(F.abs(skewness) < 0.5, "approximately_normal")
        .when(skewness > 0.5, "right_skewed")
        .otherwise("left_skewed")
    )


def measure_numbers(df: DataFrame, columns: list[str] | None = None, quantiles: bool = True, probabilities: tuple[float, ...] = ()) -> dict[str, dict]:
    """Moments, quartiles, limits of the quartiles and what lies beyond them, per numeric column: two scans, one without ``quantiles``.

    ``probabilities`` asks for more quantiles, under ``quantiles``.
    """
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return {}
    wanted = (0.25, 0.5, 0.75, *probabilities) if quantiles else probabilities
    facts = column_facts(doubles(df, columns), columns, wanted, (1.5, 3.0) if quantiles else ())
    return {c: number_stats(c, facts[c]) for c in columns}


def number_stats(name: str, facts: dict) -> dict:
    """What ``column_facts`` found of one column, by the names of the profile."""
    s, q = facts["summary"], facts["quantiles"]
    out = dict.fromkeys(("total", "mean", "std", "std_pop", "min", "max", "skewness", "kurtosis", "q1", "median", "q3"))
    out.update(column_name=name, count=s.n, quantiles=q)
    if not s.n:
        return out
    n = s.n
    g1 = math.sqrt(n) * s.m3 / s.m2**1.5 if s.m2 else 0.0
    g2 = n * s.m4 / (s.m2 * s.m2) - 3.0 if s.m2 else 0.0
    out.update(
        total=s.total, mean=s.mean, min=s.low, max=s.high, std_pop=math.sqrt(s.m2 / n), std=math.sqrt(s.m2 / (n - 1)) if n > 1 else None,
        skewness=(g1 * math.sqrt(n * (n - 1)) / (n - 2) if s.m2 else 0.0) if n >= 3 else None,
        kurtosis=((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if s.m2 else 0.0) if n >= 4 else None)
    if facts["fences"]:
        lower, upper, under, over, _, _ = facts["fences"][1.5]
        far_lower, far_upper, far_under, far_over, below, above = facts["fences"][3.0]
        out.update(
            q1=q[0.25], median=q[0.5], q3=q[0.75], iqr=q[0.75] - q[0.25], lower=lower, upper=upper, far_lower=far_lower, far_upper=far_upper,
            outliers=under + over, extremes=far_under + far_over,
            min_extreme=s.low if far_under else above if far_over else None, max_extreme=s.high if far_over else below if far_under else None)
    return out


def rows_frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small report (one row per column, rule or step) as a DataFrame."""
    fields = T._parse_datatype_string(schema)
    names = fields.names
    casts = {f.name: float for f in fields.fields if isinstance(f.dataType, T.DoubleType)}

    def value(row: dict, name: str):
        x = row.get(name)
        return casts[name](x) if x is not None and name in casts else x

    return spark.createDataFrame([tuple(value(r, n) for n in names) for r in rows], schema)


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    stats = measure_numbers(df, columns)
    raw = rows_frame(
        df.sparkSession, [s for s in stats.values() if s["count"]],
        "column_name string, mean double, median double, std double, min double, max double, q1 double, "
        "q3 double, skewness double, kurtosis double",
    )
    two = [F.round(c, 2).alias(c) for c in ("mean", "median", "std", "min", "max", "q1", "q3")]
    return raw.select("column_name", *two, F.round("skewness", 3).alias("skewness"), F.round("kurtosis", 3).alias("kurtosis"))


def iqr_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    stats = measure_numbers(df, columns)
    raw = rows_frame(
        df.sparkSession, [s for s in stats.values() if s["count"]],
        "column_name string, count long, outliers long, lower double, upper double",
    )
    return raw.select(
        "column_name", "outliers", share(F.col("outliers"), F.col("count")).alias("outlier_pct"),
        F.round("lower", 2).alias("lower_bound"), F.round("upper", 2).alias("upper_bound"),
    )


def distribution_shapes(df: DataFrame) -> DataFrame:
    return moments(df).filter(F.col("count") > 0).select(
        "column_name", distribution_shape(F.col("skewness")).alias("distribution"))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5, ascending: bool = False) -> DataFrame:
    """The ``k`` most (or least) frequent values of each text column, ties by value.

    Counts are taken per value key, so long texts do not travel; the rank filter is pushed
    before the shuffle as a per-task limit. Long winners get their text back in a second scan.
    """
    return first_values(value_counts(df, columns), k, ascending)


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, value, n): the distinct values of each text column, long ones as digests, and how often they come."""
    present = long_text(df, columns).filter(F.col("value").isNotNull())
    return present.groupBy("column_name", value_key(F.col("value")).alias("value")).agg(F.count("*").alias("n"))


def first_values(counted: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    order = [F.asc("n") if ascending else F.desc("n"), F.asc("value")]
    return (
        counted.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy(*order)))
        .filter(F.col("rank") <= k)
        .select("column_name", "rank", "value", "n")
    )


def restore_long_values(df: DataFrame, ranked: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replace digests in a top-value report by the texts they stand for, which are among ``columns``.

    The report holds at most ``k`` rows per column, so it is safe to broadcast.
    """
    digests = ranked.filter(F.col("value").startswith("md5:")).select("column_name", F.col("value").alias("key"))
    texts = (
        long_text(df, columns)
        .filter(F.length("value") > 40)
        .withColumn("key", value_key(F.col("value")))
        .join(F.broadcast(digests), ["column_name", "key"], "left_semi")
        .groupBy("column_name", F.col("key").alias("value"))
        .agg(F.min("value").alias("text"))
    )
    return ranked.join(F.broadcast(texts), ["column_name", "value"], "left").select(
        "column_name", "rank", F.coalesce("text", "value").alias("value"), "n")


def mode_frequency(df: DataFrame) -> DataFrame:
    """Most frequent text value (smallest among ties) and its share of the non-null values."""
    present = long_text(df).filter(F.col("value").isNotNull())
    counted = present.groupBy("column_name", value_key(F.col("value")).alias("value")).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))
    return (
        counted.groupBy("column_name")
        .agg(best.alias("best"), F.sum("n").alias("total"))
        .select("column_name", F.col("best.value").alias("mode"), share(-F.col("best.n"), F.col("total")).alias("mode_frequency"))
    )


def text_measures(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All counts over text values that quality, threats and corrections need, in one scan."""
    return count_flags(folded_text(df, columns), text_flags(F.col("value")))


def text_flags(v: Column) -> dict[str, Column]:
    flags = {
        "present": v.isNotNull(),
        "numeric_like": numeric_looking(v),
        "references": v.rlike(K.REFERENCE_MARK),
        "currency": v.rlike(K.CURRENCY),
        "edge_space": v != strip(v),
        "year_like": v.rlike(K.YEAR_RANGE),
        **{name: v.rlike(p) for name, p in K.PII_PATTERNS.items()},
    }
    flags["email"] = v.contains("@") & flags["email"]  # the pattern alone backtracks on long words
    for name, possible in {"references": v.contains("["), "phone": F.length(v) >= 11, "ssn": v.contains("-"), "credit_card": F.length(v) >= 13}.items():
        flags[name] = possible & flags[name]  # no shorter text has that many digits
    flags["edge_space"] = ~bare(v) & flags["edge_space"]
    return flags


def count_flags(folded: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """How often each condition on ``folded_text`` holds, per column. Flags are projected first: sums of plain
    integers keep the aggregate's generated code small."""
    marked = folded.select("column_name", *[F.when(f, F.col("n")).alias(k) for k, f in flags.items()])
    return marked.groupBy("column_name").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in flags])


FORMS = {"distinct": lambda x: x, "distinct_lower": F.lower, "distinct_norm": norm}


def text_forms(columns: list[str]) -> dict[str, Column]:
    """The values of each column as written, lower-cased, and lower-cased and stripped; three in a row per column."""
    return {f"{i}:{k}": form(col(c)) for i, c in enumerate(columns) for k, form in FORMS.items()}


def text_distincts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values as written, lower-cased, and lower-cased and stripped."""
    columns = text_columns(df) if columns is None else columns
    found = distincts(df, text_forms(columns))
    if not columns:
        return found.select(F.col("name").alias("column_name"), *[F.col("distinct").alias(k) for k in FORMS])
    place = F.array_position(F.array(*[F.lit(n) for n in text_forms(columns)]), F.col("name")).cast("int") - 1
    named = found.filter("present > 0").withColumn("place", place).withColumn("column_name", F.array(*[F.lit(c) for c in columns])[F.floor(F.col("place") / 3).cast("int")])
    return named.groupBy("column_name").agg(*[F.max(F.when(F.col("place") % 3 == i, F.col("distinct"))).alias(k) for i, k in enumerate(FORMS)])


def short_text_measures(counted: DataFrame) -> tuple[dict[str, dict], list[str]]:
    """What ``text_measures`` and ``text_distincts`` tell, from the stored ``value_counts``: asked once of each distinct value. And the columns
    that hold digests, of which this can't be told."""
    v = F.col("value")
    marked = counted.select("column_name", "n", v.startswith("md5:").alias("digest"), *[F.when(f, F.col("n")).alias(k) for k, f in text_flags(v).items()])
    rows = marked.groupBy("column_name").agg(
        F.count("*").alias("distinct"), F.max("digest").alias("digest"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in text_flags(v)]).collect()
    found = {r.column_name: {k: x for k, x in r.asDict().items() if k != "digest"} for r in rows if not r.digest}
    if found:
        # both forms of a value that has nothing to strip are one
        cells = [F.xxhash64(F.lower(v)), F.lit(True), bare(v), F.when(~bare(v), F.xxhash64(norm(v))), F.lit(False), F.lit(True)]
        forms = counted.filter(F.col("column_name").isin(*found)).select("column_name", F.stack(F.lit(2), *cells).alias("bits", "lower", "norm"))
        forms = forms.filter(F.col("bits").isNotNull()).groupBy("column_name", "bits").agg(F.max("lower").alias("lower"), F.max("norm").alias("norm"))
        for r in forms.groupBy("column_name").agg(F.count_if("lower").alias("lower"), F.count_if("norm").alias("norm")).collect():
            found[r.column_name].update(distinct_lower=r.lower, distinct_norm=r.norm)
    return found, [r.column_name for r in rows if r.digest]


def mixed_type_flags(df: DataFrame) -> DataFrame:
    """Text columns with some but under 80 % numeric-looking values."""
    measured = long_text(df).groupBy("column_name").agg(
        F.count("value").alias("present"), F.count_if(numeric_looking(F.col("value"))).alias("numeric_like"))
    return measured.filter("present > 0").select(
        "column_name",
        "numeric_like",
        share(F.col("numeric_like"), F.col("present"), 1).alias("numeric_parseable_pct"),
        ((F.col("numeric_like") > 0) & (F.col("numeric_like") < F.col("present") * 0.8)).alias("mixed_types"),
    )


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group. Rows meet by digest, and copies combine before the shuffle."""
    df = with_nulls(df)
    return (
        df.select(*row_digest(df)).groupBy("__row1", "__row2")
        .agg(F.count("*").alias("copies"))
        .agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
             F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("exact_duplicates"))
        .select(
            "exact_duplicates",
            share(F.col("exact_duplicates"), F.col("rows")).alias("duplicate_pct"),
            F.when(F.try_divide("exact_duplicates", "rows") > 0.05, "critical")
            .when(F.col("exact_duplicates") > 0, "warning").otherwise("none").alias("severity"),
        )
    )


# --------------------------------------------------------------------------- correlation

def spreads(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Mean, population deviation and missing count per numeric column."""
    v = F.col("value")
    rows = long_numbers(df, columns).groupBy("column_name").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_pop"), F.count(v).alias("count"), F.count("*").alias("rows"))
    return {r.column_name: {"mean": r["mean"], "std_pop": r.std_pop, "count": r["count"], "missing": r.rows - r["count"]}
            for r in rows.collect()}


def correlations(df: DataFrame, columns: list[str] | None = None, known: dict[str, dict] | None = None, against: str | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, or of every other column with ``against``, over rows where both are present.

    Means are subtracted first, which keeps sums of products accurate. Each task multiplies its batches into square blocks of counts, sums and products, whose
    size depends on the number of columns alone, and gives them once; summing the blocks of all tasks is one small shuffle. The plan is the same for
    any width. ``known`` passes column spreads measured before.
    """
    columns = numeric_columns(df) if columns is None else columns
    schema = "col1 string, col2 string, r double"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], schema)
    known = known or spreads(df, columns)
    usable = [c for c in columns if known.get(c, {}).get("count")]
    if len(usable) < 2:
        return df.sparkSession.createDataFrame([], schema)
    centred = df.select(*[(as_double(df, c) - F.lit(float(known[c]["mean"]))).alias(f"c{i}") for i, c in enumerate(usable)])
    if against is not None and against not in usable:
        return df.sparkSession.createDataFrame([], schema)
    others = list(range(len(usable))) if against is None else [usable.index(against)]
    pairs = [(i, j) for i in range(len(usable)) for j in range(len(others)) if (i < others[j] if against is None else i != others[j])]
    left, right = (np.array(x) for x in zip(*pairs))

    def blocks(batches):
        n = sx = sy = sxx = syy = sxy = 0.0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns])
            here = (~np.isnan(x)).astype("float64")
            x = np.nan_to_num(x, nan=0.0)
            there, y = here[:, others], x[:, others]
            n, sxy = n + here.T @ there, sxy + x.T @ y
            sx, sxx, sy, syy = sx + x.T @ there, sxx + (x * x).T @ there, sy + here.T @ y, syy + here.T @ (y * y)
        if np.ndim(n):
            low, high = np.minimum(left, np.array(others)[right]), np.maximum(left, np.array(others)[right])
            yield pa.RecordBatch.from_arrays(
                [pa.array(low), pa.array(high), *[pa.array(m[left, right]) for m in (n, sx, sy, sxx, syy, sxy)]], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")
    summed = centred.mapInArrow(blocks, "i long, j long, " + ", ".join(f"{s} double" for s in sums)).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])
    n = F.col("n")
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    var_x = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    var_y = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    r = F.when((n >= 2) & (var_x > 0) & (var_y > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(var_x * var_y))))
    names = F.array(*[F.lit(c) for c in usable])
    return summed.select(names[F.col("i").cast("int")].alias("col1"), names[F.col("j").cast("int")].alias("col2"), r.alias("r"))


def correlation_pairs(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs with a strong correlation, strongest first."""
    size = F.abs(F.col("r"))
    return (
        correlations(df)
        .filter(size > threshold)
        .select("col1", "col2", F.round("r", 3).alias("correlation"),
                F.when(size > 0.95, "critical").when(size > 0.85, "warning").otherwise("info").alias("severity"))
        .orderBy(F.desc(F.abs(F.col("correlation"))), "col1", "col2")
    )


# --------------------------------------------------------------------------- the full profile

METRIC_SCHEMA = (
    "column_name string, position int, kind string, dtype string, rows long, present long, missing long, "
    "distinct long, total double, mean double, median double, std double, min double, max double, q1 double, "
    "q3 double, skewness double, kurtosis double, lower double, upper double, outliers long, extremes long, "
    "min_extreme double, max_extreme double, mode string, mode_count long, numeric_like long, references long, "
    "currency long, edge_space long, year_like long, distinct_lower long, distinct_norm long, email long, "
    "phone long, ssn long, credit_card long, dates long, first_date timestamp, last_date timestamp"
)
PAIR_SCHEMA = "col1 string, col2 string, r double"
TOP_SCHEMA = "column_name string, rank int, value string, n long"


@dataclass
class TableProfile:
    """Everything later rules need, a few hundred numbers; the table is not scanned again."""

    spark: SparkSession
    name: str
    rows: int
    duplicates: int
    metrics: list[dict]
    pairs: list[dict]
    tops: list[dict] = field(default_factory=list)

    @property
    def cols(self) -> int:
        return len(self.metrics)

    def frame(self) -> DataFrame:
        return rows_frame(self.spark, self.metrics, METRIC_SCHEMA)

    def pair_frame(self) -> DataFrame:
        return rows_frame(self.spark, self.pairs, PAIR_SCHEMA)

    def top_frame(self) -> DataFrame:
        return rows_frame(self.spark, self.tops, TOP_SCHEMA)

    def metric(self, column: str) -> dict:
        return next(m for m in self.metrics if m["column_name"] == column)


def measure(df: DataFrame, name: str = "table", top_k: int = 5, known: TableProfile | None = None, changed: set[str] | None = None) -> TableProfile:
    """Profile a table in a fixed number of scans; each collects a few numbers per column.

    Where ``known`` is the profile of the table before some of its columns ``changed`` (its rows being the same, in any order), only those and new
    ones are measured; the others are read again for correlations with a changed column and for duplicate rows alone.
    """
    table = with_nulls(df)
    if known is not None and changed is not None:
        before = {m["column_name"]: m for m in known.metrics}
        same = [f.name for f in df.schema.fields if f.name not in changed and before.get(f.name, {}).get("dtype") == f.dataType.simpleString()]
        if same:
            return _measure_changed(table, name, top_k, known, same)
    with held(table) as table:
        return _measure(table, name, top_k)


def _measure_changed(df: DataFrame, name: str, top_k: int, known: TableProfile, same: list[str]) -> TableProfile:
    fresh = [c for c in df.columns if c not in same]
    metrics = {c: dict(known.metric(c)) for c in same}
    tops = [t for t in known.tops if t["column_name"] in same]
    pairs = [p for p in known.pairs if p["col1"] in same and p["col2"] in same]
    if fresh:
        with held(df.select(*[col(c) for c in fresh])) as part:
            own = _measure(part, name, top_k, whole=False)
        metrics.update({m["column_name"]: m for m in own.metrics})
        tops += own.tops
    for i, c in enumerate(df.columns):
        metrics[c]["position"] = i
    numbers = numeric_columns(df)
    if any(c in fresh for c in numbers):
        pairs = _pairs(df, numbers, metrics)
    order = {c: i for i, c in enumerate(df.columns)}
    tops.sort(key=lambda r: (order[r["column_name"]], r["rank"]))
    duplicates = known.duplicates if not fresh and len(same) == known.cols else _duplicates(df, known.rows, metrics)
    return TableProfile(df.sparkSession, name, known.rows, duplicates, [metrics[c] for c in df.columns], pairs, tops)


def _duplicates(df: DataFrame, rows: int, metrics: dict[str, dict]) -> int:
    """Rows beyond the first of each identical group: none where a column tells all rows apart."""
    if any(m.get("distinct") == rows for m in metrics.values()):
        return 0
    return duplicate_summary(df).first().exact_duplicates


def _pairs(df: DataFrame, numbers: list[str], metrics: dict[str, dict]) -> list[dict]:
    """Correlations of all pairs of numeric columns whose moments are known."""
    spread = {c: {**metrics[c], "count": metrics[c].get("count", metrics[c]["present"]), "missing": metrics[c]["missing"]} for c in numbers}
    pairs = [r.asDict() for r in correlations(df, numbers, spread).filter("r is not null").collect()]
    order = {c: i for i, c in enumerate(numbers)}
    return sorted(pairs, key=lambda p: (order[p["col1"]], order[p["col2"]]))


def column_states(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, rows, state columns): the mergeable summary of every numeric column of a batch, one scan. Stored, it stands for the batch."""
    columns = numeric_columns(df) if columns is None else columns
    found, rows = summaries(doubles(df, columns)) if columns else {}, df.count()
    batch = state_rows({i: found.get(i, Summary()) for i in range(len(columns))})
    frame = df.sparkSession.createDataFrame(pa.Table.from_batches([batch]))
    return frame.select(F.array(*[F.lit(c) for c in columns or [""]])[F.col("key").cast("int")].alias("column_name"), F.lit(rows).cast("long").alias("rows"), *frame.columns[1:])


def merge_states(states: DataFrame, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column from the stored states of any number of batches: counts, moments, range, and two values that each quantile lies between for certain.

    No batch is read again. States of a column meet in groups of batches first, so no task holds many.
    """
    kept = [f.split()[0] for f in STATE.split(", ")][1:]
    schema = "column_name string, rows long, " + STATE.split(", ", 1)[1]

    def fold(table: pa.Table) -> pa.Table:
        whole = merged(s for _, s in read_states(table.select(kept).add_column(0, "key", pa.array([0] * table.num_rows, pa.int64()))))
        own = pa.Table.from_batches([state_rows({0: whole})]).drop_columns(["key"])
        names = pa.array([table["column_name"][0].as_py()], pa.string())
        return own.add_column(0, "rows", pa.array([sum(table["rows"].to_pylist())], pa.int64())).add_column(0, "column_name", names)

    def told(table: pa.Table) -> pa.Table:
        out = fold(table)
        s = next(iter(read_states(out.select(kept).add_column(0, "key", pa.array([0], pa.int64())))))[1]
        stats = number_stats(table["column_name"][0].as_py(), {"summary": s, "quantiles": {}, "fences": {}})
        columns = {"column_name": [stats["column_name"]], "rows": out["rows"].to_pylist(), "present": [s.n]}
        columns |= {k: pa.array([stats[k]], pa.float64()) for k in ("total", "mean", "std", "min", "max", "skewness", "kurtosis")}
        for p in probabilities:
            at = p * (s.n - 1)
            low, high = (s.bracket(math.floor(at))[0], s.bracket(math.ceil(at))[1]) if s.n else (None, None)
            columns |= {f"q{round(p * 100)}_low": pa.array([low], pa.float64()), f"q{round(p * 100)}_high": pa.array([high], pa.float64())}
        return pa.table(columns)

    grouped = states.withColumn("group", F.pmod(F.xxhash64("vals", "n", "total"), F.lit(64))).groupBy("column_name", "group").applyInArrow(fold, schema)
    out = "column_name string, rows long, present long, " + ", ".join(f"{k} double" for k in ("total", "mean", "std", "min", "max", "skewness", "kurtosis"))
    out += "".join(f", q{round(p * 100)}_{side} double" for p in probabilities for side in ("low", "high"))
    return grouped.groupBy("column_name").applyInArrow(told, out)


def outline(df: DataFrame, name: str = "table") -> TableProfile:
    """Counts, distinct values and moments of every column in two scans: a profile without quantiles, text measures, pairs and duplicates."""
    with held(with_nulls(df)) as table:
        metrics, _, rows = _counted(table, [], {})
        for c, s in measure_numbers(table, quantiles=False).items():
            metrics[c].update({k: v for k, v in s.items() if k != "column_name"})
        return TableProfile(df.sparkSession, name, rows, 0, list(metrics.values()), [])


def _counted(df: DataFrame, text: list[str], short: dict[str, dict]) -> tuple[dict[str, dict], dict, int]:
    """Per column its place, kind, rows, present and distinct values; the counts of the forms of ``text`` columns beside them; the rows of the table.
    One scan, which leaves out the columns known from ``short``."""
    forms = text_forms(text)
    metrics = {
        f.name: {"column_name": f.name, "position": i, "kind": kind_of(f.dataType), "dtype": f.dataType.simpleString()}
        for i, f in enumerate(df.schema.fields)
    }
    countable = [c for c in countable_columns(df) if c not in text and c not in short]
    others = [c for c in df.columns if c not in countable and c not in text and c not in short]  # maps: present or not is all that is counted
    cells = {f"c:{c}": col(c) for c in countable} | {f"m:{c}": F.when(col(c).isNotNull(), F.lit(0)) for c in others} | forms
    counts = {r["name"]: r for r in distincts(df, cells).collect()}
    rows = next((r.rows for r in counts.values()), 0) if cells else df.count()
    for c in df.columns:
        if c in short:
            metrics[c].update(rows=rows, missing=rows - short[c]["present"], **short[c])
            continue
        found = counts.get(f"c:{c}" if c in countable else f"m:{c}" if c in others else f"{text.index(c)}:distinct")
        present = found.present if found else 0
        metrics[c].update(rows=rows, present=present, missing=rows - present)
        if c not in others:
            metrics[c]["distinct"] = found.distinct if found else 0
    return metrics, counts, rows


def _measure(df: DataFrame, name: str, top_k: int, whole: bool = True) -> TableProfile:
    """Every metric of a table; without ``whole``, none that looks at several columns."""
    spark = df.sparkSession
    text, numbers = text_columns(df), numeric_columns(df)
    counted, short, digests = None, {}, []
    if text:
        counted = cut_lineage(value_counts(df, text))
        short, digests = short_text_measures(counted)
        empty = dict.fromkeys((*FORMS, *text_flags(F.lit(""))), 0)
        short = {c: short.get(c, empty) for c in text if c not in digests}
    metrics, counts, rows = _counted(df, digests, short)
    for c, s in measure_numbers(df, numbers).items():
        metrics[c].update({k: v for k, v in s.items() if k != "column_name"})
    tops = []
    if digests:
        for i, c in enumerate(digests):
            metrics[c].update({k: counts[f"{i}:{k}"].distinct for k in FORMS})
        for r in text_measures(df, digests).collect():
            metrics[r.column_name].update(r.asDict())
    if text:
        tops = [r.asDict() for r in first_values(counted, top_k).collect()]
        if any(r["value"].startswith("md5:") for r in tops):
            tops = [r.asDict() for r in restore_long_values(df, rows_frame(spark, tops, TOP_SCHEMA), digests).collect()]
        tops.sort(key=lambda r: (metrics[r["column_name"]]["position"], r["rank"]))
        for r in tops:
            if r["rank"] == 1:
                metrics[r["column_name"]].update(mode=r["value"], mode_count=r["n"])
    for c, (n, first, last) in date_spans(df).items():
        metrics[c].update(dates=n, first_date=first, last_date=last)
    duplicates = _duplicates(df, rows, metrics) if whole else 0
    pairs = _pairs(df, numbers, metrics) if whole else []
    return TableProfile(spark, name, rows, duplicates, list(metrics.values()), pairs, tops)


def date_spans(df: DataFrame) -> dict[str, tuple[int, dt.datetime | None, dt.datetime | None]]:
    """Parsed values and their range for date columns and for text columns named like dates."""
    cells = {}
    for f in df.schema.fields:
        kind = kind_of(f.dataType)
        if kind == "datetime":
            cells[f.name] = col(f.name).cast("timestamp")
        elif kind == "text" and any(w in f.name.lower() for w in K.FRESHNESS_NAMES):
            cells[f.name] = parse_date(col(f.name))
    if not cells:
        return {}
    long = unpivot(df.select(*[e.alias(c) for c, e in cells.items()]), list(cells))
    rows = long.groupBy("column_name").agg(F.count("value").alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))
    return {r.column_name: (r.n, r.a, r.b) for r in rows.collect()}


def full_profile(df: DataFrame) -> DataFrame:
    """The whole profile as one row per column."""
    return profile_report(measure(df))


def profile_report(p: TableProfile) -> DataFrame:
    c = F.col
    return p.frame().select(
        "column_name", "kind", "missing",
        share(c("missing"), c("rows")).alias("missing_pct"),
        "distinct",
        share(c("distinct"), c("rows")).alias("distinct_pct"),
        cardinality_class(c("distinct"), c("rows")).alias("cardinality"),
        *[F.round(c(x), 2).alias(x) for x in ("mean", "median", "std", "min", "max", "q1", "q3")],
        F.round("skewness", 3).alias("skewness"),
        F.round("kurtosis", 3).alias("kurtosis"),
        "outliers",
        share(c("outliers"), c("present")).alias("outlier_pct"),
        F.when(c("kind") == "numeric", distribution_shape(c("skewness"))).alias("distribution"),
        "mode",
        share(c("mode_count"), c("present")).alias("mode_frequency"),
    )
