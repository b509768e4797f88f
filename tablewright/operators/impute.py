"""Imputation, clipping and ordered fills. Fill values are measured once and become literals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.quantiles import exact_quantiles
from tablewright.functions.segments import segmented
from tablewright.functions.text import col, strip, title_case
from tablewright.operators import profile as P
from tablewright.operators.profile import TableProfile, cardinality_class

STRATEGIES = ["skip", "zero", "median", "mean", "mode", "unknown", "median_indicator"]
ACTIONS = {
    "median": ("IMPUTE_MEDIAN", 90), "mean": ("IMPUTE_MEAN", 88), "mode": ("IMPUTE_MODE", 86), "zero": ("IMPUTE_ZERO", 80),
    "unknown": ("IMPUTE_UNKNOWN", 82), "median_indicator": ("IMPUTE_MEDIAN_WITH_INDICATOR", 84), "skip": ("SKIP_COLUMN", 70),
}


def choose_imputation(p: TableProfile, plan: dict[str, str] | None = None) -> DataFrame:
    """Strategy per column with missing values; a valid entry of the supplied plan wins."""
    c = F.col
    pct = F.round(c("missing") * 100.0 / c("rows"), 2)
    few = cardinality_class(c("distinct"), c("rows")).isin("Low", "Binary", "Moderate")
    skewed = F.abs(F.coalesce(F.round("skewness", 3), F.lit(0.0))) > 1
    number, text = c("kind") == "numeric", c("kind") == "text"
    rule = (
        F.when(number & (pct > 50), "median_indicator").when(number & (pct < 30) & skewed, "median")
        .when(number & (pct < 30), "mean").when(number, "skip").when(pct > 50, "skip")
        .when(text & (pct < 20) & few, "mode").when(text & (pct < 30), "unknown").otherwise("skip"))
    chosen = [(k, v) for k, v in (plan or {}).items() if v in STRATEGIES]
    if chosen:
        given = F.create_map(*[F.lit(x) for kv in chosen for x in kv])[c("column_name")]
        rule = F.coalesce(given, rule)
    return p.frame().filter("missing > 0").select("column_name", pct.alias("missing_pct"), rule.alias("strategy"))


@dataclass
class Fill:
    column: str
    strategy: str
    value: object
    rows: int


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(P.doubles(df, columns), columns, [0.5]).items()}


def means(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    rows = P.long_numbers(df, columns).groupBy("column_name").agg(F.avg("value").alias("mean")).collect()
    return {r.column_name: r["mean"] for r in rows}


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent text, smallest among ties; 'Unknown' where a column has no values."""
    rows = P.restore_long_values(df.select(*[col(c) for c in columns]), P.top_values(df, columns, 1)).collect()
    found = {r.column_name: r.value for r in rows}
    return {c: found.get(c, "Unknown") for c in columns}


def filled(df: DataFrame, name: str, value: object) -> Column:
    """The column with NULLs replaced; whole-number columns widen when the value needs it."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType) and isinstance(value, (int, float)):
        x = P.as_double(df, name) if isinstance(kind, (T.DoubleType, T.FloatType)) else col(name)
        if isinstance(kind, T.IntegralType) and float(value) == int(value):
            return F.coalesce(x, F.lit(int(value)).cast(kind))
        return F.coalesce(x.cast("double"), F.lit(float(value)))
    return F.coalesce(col(name), F.lit(value))


def measure_fills(df: DataFrame, choices: dict[str, str], outline: TableProfile | None = None) -> list[Fill]:
    """Fill values for the chosen strategies, one pass per kind of statistic; what ``outline`` has measured is not measured again."""
    df = P.with_nulls(df)
    if outline:
        missing = {m["column_name"]: m["missing"] for m in outline.metrics}
    else:
        missing = {r.column_name: r.missing for r in P.missing_counts(df.select(*[col(c) for c in choices])).collect()}
    by = {s: [c for c, k in choices.items() if k == s and missing[c]] for s in STRATEGIES}
    value: dict[str, object] = {}
    middle = by["median"] + by["median_indicator"]
    if middle:
        value.update(medians(df, middle))
    if by["mean"]:
        value.update({c: outline.metric(c)["mean"] for c in by["mean"]} if outline else means(df, by["mean"]))
    if by["mode"]:
        value.update(modes(df, by["mode"]))
    value.update({c: 0 for c in by["zero"]})
    value.update({c: "Unknown" for c in by["unknown"]})
    return [Fill(c, s, value.get(c), missing[c]) for c, s in choices.items() if missing[c]]


def apply_fills(df: DataFrame, fills: list[Fill]) -> tuple[DataFrame, list[dict]]:
    """One projection for all fills, with indicator columns added at the end. NaN counts as missing."""
    df = P.with_nulls(df)
    use = {f.column: f for f in fills if f.strategy != "skip" and f.value is not None}
    out = [filled(df, c, use[c].value).alias(c) if c in use else col(c) for c in df.columns]
    taken = set(df.columns)
    for f in fills:
        if f.strategy == "median_indicator" and f.column in use:
            name = f"{f.column}_was_missing"
            while name in taken:
                name += "_flag"
            taken.add(name)
            out.append(col(f.column).isNull().cast("int").alias(name))
    audit = [{"step": i, "action": ACTIONS[f.strategy][0], "column_name": f.column,
              "rows_affected": 0 if f.strategy == "skip" else f.rows, "confidence": ACTIONS[f.strategy][1], "source": "deterministic"}
             for i, f in enumerate(fills)]
    return df.select(*out), audit


def impute(df: DataFrame, choices: dict[str, str], outline: TableProfile | None = None) -> tuple[DataFrame, list[dict]]:
    if not choices:
        return df, []
    return apply_fills(df, measure_fills(df, choices, outline))


def impute_with(df: DataFrame, strategy: str, columns: list[str]) -> DataFrame:
    return impute(df, {c: strategy for c in columns})[0]


# --------------------------------------------------------------------------- case, clipping


def case_columns(df: DataFrame, limit: int = 50) -> list[str]:
    """Text columns with case variants and few distinct values."""
    found = P.text_distincts(df).filter((F.col("distinct") > F.col("distinct_lower")) & (F.col("distinct") <= limit)).collect()
    names = {r.column_name for r in found}
    return [c for c in P.text_columns(df) if c in names]


def standardize_case(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, list[dict]]:
    """Strip and title-case; missing values stay missing."""
    columns = case_columns(df) if columns is None else columns
    if not columns:
        return df, []
    counts = P.missing_counts(df.select(*[col(c) for c in columns])).collect()
    present = {r.column_name: r.rows - r.missing for r in counts}
    audit = [{"step": i, "action": "STANDARDIZE_CASE", "column_name": c, "rows_affected": present[c], "confidence": 94,
              "source": "deterministic"} for i, c in enumerate(columns)]
    return df.select(*[title_case(strip(col(c))).alias(c) if c in columns else col(c) for c in df.columns]), audit


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Drop exact copies. Copies combine before the shuffle, so a hot row costs no more."""
    return df.dropDuplicates()


def winsorize(df: DataFrame, columns: list[str] | None = None, least_pct: float = 2.0) -> tuple[DataFrame, list[dict]]:
    """Clip to the 1st and 99th percentile the columns with more than 2 % outliers."""
    stats = P.measure_numbers(df, columns, probabilities=(0.01, 0.99))
    wide = {c: s for c, s in stats.items() if s["count"] and round(s["outliers"] * 100.0 / s["count"], 2) > least_pct}
    if not wide:
        return df, []
    out, counts = {}, []
    for i, c in enumerate(wide):
        low, high = wide[c]["quantiles"][0.01], wide[c]["quantiles"][0.99]
        kind, x = df.schema[c].dataType, P.as_double(df, c)
        if isinstance(kind, T.IntegralType):
            low, high = round(low), round(high)
        clipped = F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))  # both skip NULL
        out[c] = F.when(x.isNotNull(), clipped).cast(kind)
        counts.append(F.count_if((x < low) | (x > high)).alias(f"n{i}"))
    row = df.agg(*counts).first()
    audit = [{"step": i, "action": "CLIP_OUTLIERS", "column_name": c, "rows_affected": row[f"n{i}"], "confidence": 78,
              "source": "deterministic"} for i, c in enumerate(out)]
    return df.select(*[out[c].alias(c) if c in out else col(c) for c in df.columns]), audit


# --------------------------------------------------------------------------- ordered operators


def forward_fill(df: DataFrame, order_by: str, tie_break: str, keys: list[str], columns: list[str] | None = None,
                 most_missing: float = 0.15, segments: int | None = None) -> DataFrame:
    """Carry the last value forward within each key, in (order_by, tie_break) order.

    The order is cut into segments, ties by ``tie_break``. Values are carried inside a (key, segment)
    group by a window, and across segments by a window over one row per group, so a key, or a moment, with a
    third of all rows is spread over many segments.
    """
    columns = P.numeric_columns(df) if columns is None else columns
    counts = {r.column_name: r for r in P.missing_counts(df.select(*[col(c) for c in columns])).collect()}
    todo = [c for c in columns if c not in (order_by, tie_break) and 0 < counts[c].missing <= counts[c].rows * most_missing]
    if not todo:
        return df
    marked = segmented(df, [order_by, tie_break], segments)
    group = [col(k) for k in keys] + [F.col("__segment")]
    within = Window.partitionBy(*group).orderBy(col(order_by), col(tie_break)).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(col(order_by), col(tie_break))
    ends = marked.groupBy(*group).agg(*[F.max_by(col(c), F.when(col(c).isNotNull(), at)).alias(f"__end{i}") for i, c in enumerate(todo)])
    before = Window.partitionBy(*([col(k) for k in keys] or [F.lit(0)])).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__segment").alias("__after"),
        *[F.last(f"__end{i}", ignorenulls=True).over(before).alias(f"__carry{i}") for i in range(len(todo))])
    inside = marked.withColumns({f"__inside{i}": F.last(col(c), ignorenulls=True).over(within) for i, c in enumerate(todo)})
    match = F.col("__segment") == F.col("__after")
    for i, k in enumerate(keys):
        match = match & col(k).eqNullSafe(F.col(f"__key{i}"))
    joined = inside.join(carried, match, "left")
    values = {c: F.coalesce(f"__inside{i}", f"__carry{i}") for i, c in enumerate(todo)}
    return joined.select(*[values[c].alias(c) if c in values else col(c) for c in df.columns])


def forward_fill_sorted(df: DataFrame, order_by: str, tie_break: str, keys: list[str] | tuple[str, ...] = (), **options) -> tuple[DataFrame, list[dict]]:
    """Forward fill where ``order_by`` rises or falls steadily along ``tie_break``, the order the rows came in; else the table as it is."""
    steady = monotonic_check(df, order_by, tie_break).first()
    if not (steady.non_decreasing or steady.non_increasing):
        return df, []
    numbers = options.get("columns") or P.numeric_columns(df)
    filled = forward_fill(df, order_by, tie_break, list(keys), **options)
    before, after = ({r.column_name: r.missing for r in P.missing_counts(x.select(*[col(c) for c in numbers])).collect()} for x in (df, filled))
    audit = [{"step": i, "action": "FORWARD_FILL", "column_name": c, "rows_affected": before[c] - after[c], "confidence": 82, "source": "deterministic"}
             for i, c in enumerate(c for c in numbers if before[c] > after[c])]
    return filled, audit


def monotonic_check(df: DataFrame, value: str, order_by: str, segments: int | None = None) -> DataFrame:
    """Is a column non-decreasing or non-increasing in the order of a unique column?

    Neighbours are compared inside segments of the order, then the ends of adjacent segments.
    """
    rows = segmented(df.filter(col(value).isNotNull()).select(col(value).alias("v"), col(order_by).alias("at")), ["at"], segments).withColumnRenamed("__segment", "segment")
    step = Window.partitionBy("segment").orderBy("at")
    inside = (
        rows.withColumn("previous", F.lag("v").over(step)).groupBy("segment")
        .agg(F.count_if(F.col("v") < F.col("previous")).alias("down"), F.count_if(F.col("v") > F.col("previous")).alias("up"),
             F.min_by("v", "at").alias("first"), F.max_by("v", "at").alias("last"), F.lit(1).alias("all")))
    joint = Window.partitionBy("all").orderBy("segment")  # one row per segment
    ends = inside.withColumn("before", F.lag("last").over(joint))
    return ends.agg(
        F.coalesce(F.sum(F.col("down") + F.coalesce(F.col("first") < F.col("before"), F.lit(False)).cast("int")), F.lit(0)).alias("decreases"),
        F.coalesce(F.sum(F.col("up") + F.coalesce(F.col("first") > F.col("before"), F.lit(False)).cast("int")), F.lit(0)).alias("increases"),
    ).select("increases", "decreases", (F.col("decreases") == 0).alias("non_decreasing"), (F.col("increases") == 0).alias("non_increasing"))
