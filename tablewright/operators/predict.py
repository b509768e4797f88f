"""Missing-value prediction, trends, anomalies and feature suggestions."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import (FeatureHasher, IndexToString, OneHotEncoder, RobustScaler, StandardScaler, StringIndexer,
                                TargetEncoder, VectorAssembler)
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.dates import parse_date
from tablewright.functions.quantiles import exact_quantiles
from tablewright.functions.segments import haloed
from tablewright.functions.text import col
from tablewright.operators import impute
from tablewright.operators import profile as P

DAY_MICROS = 86_400_000_000
LABELLED = 200_000  # rows, about, that a forest learns from: those with the smallest hash of their id
FOREST = {"numTrees": 50, "maxDepth": 12, "maxBins": 64, "seed": 42}
LEAST_ANOMALY_ROWS = 20

# --------------------------------------------------------------------------- missing values


def feature_columns(df: DataFrame, target: str, skip: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns more than half filled, other than the target."""
    numbers = [c for c in P.numeric_columns(df) if c != target and c not in skip]
    if not numbers:
        return []
    counts = {r.column_name: r for r in P.missing_counts(df.select(*[col(c) for c in numbers])).collect()}
    return [c for c in numbers if counts[c].rows - counts[c].missing > counts[c].rows * 0.5]


def _features(df: DataFrame, target: str, id: str) -> tuple[DataFrame, list[str]]:
    """Target and median-filled features as one vector."""
    columns = feature_columns(df, target, (id,))
    middle = impute.medians(df.filter(col(target).isNotNull()), columns)
    filled = df.select(col(id), col(target), *[F.coalesce(P.as_double(df, c), F.lit(float(middle[c] or 0.0))).alias(c) for c in columns])
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled), columns


def _forest(df: DataFrame, target: str, id: str, numeric: bool):
    """Fitted model, labelled rows and unlabelled rows; None when there is too little to learn from.

    Forests have the depth and bins of ``FOREST``; numbers are learned over all features at each split, classes over a random share.
    """
    table, columns = _features(df, target, id)
    known = table.filter(col(target).isNotNull())
    labelled = known.count() if columns else 0
    if labelled < 10:
        return None
    share = min(1.0, LABELLED / labelled)
    known = known.filter(F.pmod(F.xxhash64(col(id)), F.lit(1_000_000)) < F.lit(int(1_000_000 * share)))
    settings = dict(featuresCol="features", **FOREST)
    if numeric:
        settings["featureSubsetStrategy"] = "all"
        known = known.withColumn("label", col(target).cast("double"))
        model = RandomForestRegressor(labelCol="label", **settings).fit(known)
        return model, known, table.filter(col(target).isNull()), columns, None
    indexer = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(known)
    known = indexer.transform(known)
    model = RandomForestClassifier(labelCol="label", **settings).fit(known)
    return model, known, table.filter(col(target).isNull()), columns, indexer.labels


def predict_missing(df: DataFrame, target: str, id: str) -> DataFrame:
    """(id, predicted value) for the rows where the target is missing."""
    numeric = target in P.numeric_columns(df)
    fitted = _forest(df, target, id, numeric)
    if fitted is None:
        value = statistical_fallback(df, target).first()["suggested_fill"]
        return df.filter(col(target).isNull()).select(col(id), F.lit(value).alias("predicted_value"))
    model, _, unknown, _, labels = fitted
    predicted = model.transform(unknown)
    if numeric:
        return predicted.select(col(id), F.round("prediction", 2).alias("predicted_value"))
    named = IndexToString(inputCol="prediction", outputCol="predicted_value", labels=labels).transform(predicted)
    return named.select(col(id), "predicted_value")


def prediction_summary(df: DataFrame, target: str, id: str) -> DataFrame:
    """(item, value): training score, top importances, and the spread or counts of predictions."""
    numeric = target in P.numeric_columns(df)
    found = _forest(df, target, id, numeric)
    missing = df.filter(col(target).isNull()).count()
    if found is None:  # the fallback answers, as in predict_missing
        return P.rows_frame(df.sparkSession, [{"item": "method statistical_fallback", "value": 1.0}, {"item": "missing_count", "value": missing}], "item string, value double")
    model, known, unknown, columns, labels = found
    fitted = model.transform(known)
    if numeric:
        score = RegressionEvaluator(labelCol="label", metricName="r2").evaluate(fitted)
    else:
        score = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy").evaluate(fitted)
    weights = sorted(zip(columns, model.featureImportances.toArray()), key=lambda x: -x[1])[:5]
    rows = [{"item": "method random_forest", "value": 1.0}, {"item": "train_score", "value": round(score, 3)}] + ([] if numeric else [{"item": "missing_count", "value": missing}]) + [{"item": f"importance {c}", "value": round(float(w), 3)} for c, w in weights]
    facts = P.rows_frame(df.sparkSession, rows, "item string, value double")
    predicted = model.transform(unknown)
    if numeric:
        p = F.col("prediction")
        spread = predicted.agg(F.count("*").cast("double").alias("missing_count"), F.round(F.avg(p), 2).alias("mean_predicted"),
                               F.round(F.stddev_pop(p), 2).alias("std_predicted"), F.round(F.min(p), 2).alias("min_predicted"),
                               F.round(F.max(p), 2).alias("max_predicted"))
        return facts.unionByName(spread.unpivot([], spread.columns, "item", "value"))
    names = IndexToString(inputCol="prediction", outputCol="name", labels=labels).transform(predicted)
    counts = names.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")
    return facts.unionByName(counts.select(F.concat(F.lit("predicted "), "name").alias("item"), F.col("n").cast("double").alias("value")))


def statistical_fallback(df: DataFrame, target: str) -> DataFrame:
    """Suggested fill when no model can be trained: the median, or the mode."""
    missing = P.missing_counts(df.select(col(target))).first().missing
    if target in P.numeric_columns(df):
        s = P.measure_numbers(df, [target])[target]
        row = {"column_name": target, "missing_count": missing, "suggested_fill": s.get("median"), "mean": s.get("mean")}
        frame = P.rows_frame(df.sparkSession, [row], "column_name string, missing_count long, suggested_fill double, mean double")
        return frame.select("column_name", "missing_count", F.round("suggested_fill", 2).alias("suggested_fill"), F.round("mean", 2).alias("mean"))
    row = {"column_name": target, "missing_count": missing, "suggested_fill": impute.modes(df, [target])[target]}
    return P.rows_frame(df.sparkSession, [row], "column_name string, missing_count long, suggested_fill string")


# --------------------------------------------------------------------------- time series


def _series(df: DataFrame, ts: str, value: str, keys: list[str]) -> DataFrame:
    """Valid points with whole days since each series began."""
    t = parse_date(col(ts)) if ts in P.text_columns(df) else col(ts).cast("timestamp")
    points = df.select(*[col(k) for k in keys], t.alias("ts"), P.as_double(df, value).alias("y")).filter("ts IS NOT NULL AND y IS NOT NULL")
    if not keys:
        start = points.agg(F.min("ts").alias("start")).first().start
        return points.withColumn("x", _days(F.col("ts"), F.lit(start).cast("timestamp")))
    starts = points.groupBy(*[col(k) for k in keys]).agg(F.min("ts").alias("start"))
    joined = points.join(starts, keys)  # Spark broadcasts what it measures to be small and splits hot keys
    return joined.withColumn("x", _days(F.col("ts"), F.col("start")))


def _days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / DAY_MICROS).cast("double")


def _lines(df: DataFrame, ts: str, value: str, keys: list[str]) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return _series(df, ts, value, keys).groupBy(*[col(k) for k in keys]).agg(
        F.count("*").alias("data_points"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.max(x).alias("last_x"), F.min(x).alias("first_x")).filter("data_points >= 5")


def linear_trend(df: DataFrame, ts: str, value: str, keys: list[str] = []) -> DataFrame:
    """Least-squares line through each series of at least five points."""
    slope = F.col("slope")
    return _lines(df, ts, value, keys).select(
        *[col(k) for k in keys], "data_points", F.round(slope, 4).alias("slope"), F.round("intercept", 4).alias("intercept"),
        F.round(F.coalesce("r2", F.lit(0.0)), 3).alias("r_squared"),
        F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("flat").alias("direction"))


def forecast(df: DataFrame, ts: str, value: str, keys: list[str] = [], periods: int = 10) -> DataFrame:
    """The next points of each line, one mean gap apart."""
    gap = (F.col("last_x") - F.col("first_x")) / (F.col("data_points") - 1)
    return (
        _lines(df, ts, value, keys)
        .select(*[col(k) for k in keys], "slope", "intercept", "last_x", gap.alias("gap"), F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))
        .select(*[col(k) for k in keys], "step",
                F.round(F.col("slope") * (F.col("last_x") + F.col("gap") * F.col("step")) + F.col("intercept"), 2).alias("forecast")))


def moving_average(df: DataFrame, ts: str, value: str, tie_break: str, keys: list[str], last: int = 20) -> DataFrame:
    """Last ``last`` full-window averages of each series; window min(7, n // 3), or 1 for short series.

    Only the last 26 points of a series matter, so the ranking keeps those before the shuffle and
    a hot series costs no more than a cold one.
    """
    points = df.select(*[col(k) for k in keys], col(ts).alias("ts"), col(tie_break).alias("tie"), P.as_double(df, value).alias("y")).filter(
        "ts IS NOT NULL AND y IS NOT NULL")
    by = [col(k) for k in keys]
    sizes = points.groupBy(*by).agg(F.count("*").alias("n"))
    recent = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("tie"))
    tail = points.withColumn("back", F.row_number().over(recent)).filter(F.col("back") <= last + 6)
    width = F.when(F.col("n") > 6, F.least(F.lit(7), F.floor(F.col("n") / 3))).otherwise(1)
    frame = Window.partitionBy(*by).orderBy(F.desc("back")).rowsBetween(-6, 0)
    seven = F.collect_list("y").over(frame)
    window = F.slice(seven, F.greatest(F.size(seven) - F.col("width") + 1, F.lit(1)), F.col("width"))
    mean = F.aggregate(window, F.lit(0.0), lambda a, y: a + y) / F.col("width")
    return (
        tail.join(sizes, keys).withColumn("width", width.cast("int")).withColumn("average", mean).withColumn("length", F.size(seven))
        .filter((F.col("back") <= last) & (F.col("n") - F.col("back") + 1 >= F.col("width")))
        .select(*by, F.col("back").alias("points_back"), F.col("width").alias("window"), F.round("average", 2).alias("moving_average")))


def series_summary(df: DataFrame, ts: str, value: str, tie_break: str, keys: list[str] = []) -> DataFrame:
    y = F.col("y")
    points = df.select(*[col(k) for k in keys], col(ts).alias("ts"), col(tie_break).alias("tie"), P.as_double(df, value).alias("y")).filter(
        "ts IS NOT NULL AND y IS NOT NULL")
    return points.groupBy(*[col(k) for k in keys]).agg(
        F.round(F.avg(y), 2).alias("mean"), F.round(F.stddev_pop(y), 2).alias("std"), F.round(F.min(y), 2).alias("min"),
        F.round(F.max(y), 2).alias("max"), F.round(F.max_by(y, F.struct("ts", "tie")), 2).alias("latest"))


# --------------------------------------------------------------------------- anomalies


def iqr_summary(df: DataFrame, value: str) -> DataFrame:
    """(item, value): rows, mean, deviation and fences of a column, and how many values lie outside."""
    s = P.measure_numbers(df, [value])[value]
    enough = s["count"] >= LEAST_ANOMALY_ROWS
    facts = {"count": s["count"], "anomalies": s["outliers"] if enough else 0, "anomaly_pct": round(s["outliers"] * 100.0 / s["count"], 2) if enough else 0.0,
             **({k: round(s[k], 2) for k in ("mean", "std", "lower", "upper")} if enough else {})}
    return P.rows_frame(df.sparkSession, [{"item": k, "value": v} for k, v in facts.items()], "item string, value double")


def iqr_anomalies(df: DataFrame, value: str, id: str, limit: int | None = None) -> DataFrame:
    """The values outside the fences; with a limit, the first ones in id order."""
    s = P.measure_numbers(df, [value])[value]
    v = P.as_double(df, value)
    if s["count"] < LEAST_ANOMALY_ROWS:
        return df.filter(F.lit(False)).select(col(id), F.lit(0.0).alias("value"))
    outside = (v < s["lower"]) | (v > s["upper"])
    found = df.filter(outside).select(col(id), F.round(v, 2).alias("value"))
    return found if limit is None else found.orderBy(col(id)).limit(limit)


TREES, SAMPLE = 100, 256


def _mean_path(n: int) -> float:
    """Expected depth of an unsuccessful search among n values."""
    import math

    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n


def forest_steps(df: DataFrame, value: str, id: str, seed: int = 42) -> tuple[list[float], list[float], int]:
    """A one-column isolation forest as a step function: inner cuts and the mean path in each piece.

    Every tree grows in its own task from at most 256 sampled values. A tree over one column
    is a set of intervals with depths, so the whole forest is a sum of step functions with at
    most 25,500 cuts, whatever the size of the table.
    """
    pool = (
        df.select(P.as_double(df, value).alias("v"), F.xxhash64(col(id), F.lit(seed)).alias("h"))
        .filter("v IS NOT NULL").orderBy("h", "v").limit(TREES * SAMPLE))
    sampled = pool.collect()  # 25,600 numbers at most
    if len(sampled) < LEAST_ANOMALY_ROWS:
        return [], [], len(sampled)
    size = min(SAMPLE, len(sampled))
    values = [r.v for r in sampled]
    spark = df.sparkSession
    trees = spark.range(TREES).repartition(min(TREES, spark.sparkContext.defaultParallelism), "id")
    limit = int(np.ceil(np.log2(max(size, 2))))

    mean_path = {n: _mean_path(n) for n in range(size + 1)}

    def grow(batches):
        for pdf in batches:
            out = []
            for t in pdf["id"]:
                rng = np.random.default_rng(seed + int(t))
                pick = rng.choice(values, size, replace=False)
                stack = [(np.sort(pick), -np.inf, 0)]
                while stack:
                    part, left, depth = stack.pop()
                    if depth >= limit or len(part) <= 1 or part[0] == part[-1]:
                        out.append((int(t), float(left), float(depth + mean_path[len(part)])))
                        continue
                    cut = rng.uniform(part[0], part[-1])
                    stack.append((part[part <= cut], left, depth + 1))
                    stack.append((part[part > cut], cut, depth + 1))
            yield pd.DataFrame(out, columns=["tree", "start", "path"])

    pieces = trees.mapInPandas(grow, "tree long, start double, path double").collect()
    changes: dict[float, float] = {}
    for _, group in itertools.groupby(sorted(pieces, key=lambda r: (r.tree, r.start)), key=lambda r: r.tree):
        previous = 0.0
        for r in group:
            changes[r.start] = changes.get(r.start, 0.0) + (r.path - previous) / TREES
            previous = r.path
    starts = sorted(changes)
    paths = list(itertools.accumulate(changes[s] for s in starts))
    return starts[1:], paths, size


def isolation_scores(df: DataFrame, value: str, id: str, contamination: float = 0.05) -> DataFrame:
    """(id, value, score, anomaly) from a one-column isolation forest.

    Scores are looked up in Arrow batches. The cut-off is the exact 95th percentile of the
    score, found from row counts per piece of the step function.
    """
    cuts, paths, size = forest_steps(df, value, id)
    if not paths:  # too few values to call any of them odd
        none = df.filter(P.as_double(df, value).isNotNull())
        return none.select(col(id), P.as_double(df, value).alias("value"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("anomaly"))
    scale = _mean_path(size) or 1.0
    scores = [2.0 ** (-p / scale) for p in paths]

    @F.pandas_udf("int")
    def piece(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, v.to_numpy(), side="left")).astype("int32")

    rows = df.select(col(id), P.as_double(df, value).alias("value")).filter("value IS NOT NULL").withColumn("piece", piece("value"))
    counts = rows.groupBy("piece").agg(F.count("*").alias("n")).collect()
    ordered = sorted((scores[r.piece], r.n) for r in counts)
    total = sum(n for _, n in ordered)
    at = (1 - contamination) * (total - 1)

    def ranked(rank: int) -> float:
        seen = 0
        for score, n in ordered:
            seen += n
            if rank < seen:
                return score
        return ordered[-1][0]

    low, high = ranked(int(at)), ranked(min(int(at) + 1, total - 1))
    cut_off = low + (high - low) * (at - int(at))

    @F.pandas_udf("double")
    def score_of(p: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(scores)[p.to_numpy()])

    scored = rows.withColumn("score", score_of("piece"))
    return scored.select(col(id), "value", F.round("score", 4).alias("score"), (F.col("score") > cut_off).alias("anomaly"))


def neighbour_distances(df: DataFrame, value: str, k: int = 10, segments: int | None = None) -> DataFrame:
    """(value, n, distance): mean distance from each distinct value to its k nearest rows.

    Copies are folded into counts first, so a value that fills a third of the table is one row.
    Distinct values are cut into segments; each segment also gets the k values on either
    side of it, so neighbours are exact at the edges.
    """
    distinct = df.select(P.as_double(df, value).alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    own = haloed(distinct, [], "v", "v", k, segments).withColumnsRenamed({"__segment": "segment", "__own": "own"})
    order = Window.partitionBy("segment").orderBy("v")
    near = []
    for i in range(1, k + 1):
        for shift in (F.lag, F.lead):
            gap = F.abs(F.col("v") - shift("v", i).over(order))
            copies = F.least(shift("n", i).over(order), F.lit(k)).cast("int")
            near.append(F.when(gap.isNotNull(), F.array_repeat(gap, copies)))
    same = F.array_repeat(F.lit(0.0), F.least(F.col("n") - 1, F.lit(k)).cast("int"))
    marked = own.select("v", "n", "own", same.alias("same"), *[x.alias(f"near{i}") for i, x in enumerate(near)])
    everyone = F.concat(F.col("same"), *[F.coalesce(f"near{i}", F.array().cast("array<double>")) for i in range(len(near))])
    nearest = F.slice(F.array_sort(everyone), 1, k)
    distance = F.try_divide(F.aggregate(nearest, F.lit(0.0), lambda a, d: a + d), F.size(nearest))
    return marked.filter("own").select(F.col("v").alias("value"), "n", distance.alias("distance"))


def neighbour_outliers(df: DataFrame, value: str, k: int = 10, score_below: float = 0.15, segments: int | None = None) -> dict:
    """Rows whose neighbour score exp(-distance / scale) is under 0.15.

    The scale is the row-weighted mean distance, so the score is 1 amid neighbours and falls
    towards 0 far from them. Needs more than 20 rows and two distinct values.
    """
    distances = neighbour_distances(df, value, k, segments)
    total = distances.agg(F.sum("n").alias("n"), F.count("*").alias("values"), (F.sum(F.col("distance") * F.col("n")) / F.sum("n")).alias("scale")).first()
    if not total.n or total.n <= 20 or total["values"] < 2 or not total.scale:
        return {"column_name": value, "outliers": 0, "present": total.n or 0}
    far = distances.filter(F.exp(-F.col("distance") / total.scale) < score_below).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    return {"column_name": value, "outliers": far, "present": total.n}


# --------------------------------------------------------------------------- suggestions


def feature_correlations(df: DataFrame, threshold: float = 0.3, n: int = 10) -> DataFrame:
    size = F.abs(F.col("r"))
    return P.correlations(df).filter(size > threshold).orderBy(F.desc(size), "col1", "col2").limit(n).select(
        "col1", "col2", F.round("r", 3).alias("correlation"))


def suggest_date_parts(df: DataFrame) -> DataFrame:
    """Date columns, and text columns of which more than half parse as dates."""
    spark = df.sparkSession
    dated = [{"column_name": c} for c in P.columns_of(df, "datetime")]
    text = P.text_columns(df)
    if text:
        parsed = P.count_flags(P.folded_text(df), {"all_rows": F.lit(True), "dates": parse_date(F.col("value")).isNotNull()})
        dated += [{"column_name": r.column_name} for r in parsed.filter(F.col("dates") > F.col("all_rows") * 0.5).collect()]
    frame = P.rows_frame(spark, dated, "column_name string")
    new = F.concat_ws(",", *[F.concat("column_name", F.lit(s)) for s in ("_year", "_month", "_dayofweek", "_quarter")])
    return frame.select("column_name", F.lit("date_decomposition").alias("type"), new.alias("new_features"))


def suggest_ratios(df: DataFrame) -> DataFrame:
    """Ratios of the most correlated pairs."""
    return feature_correlations(df, 0.3, 3).filter(F.abs(F.col("correlation")) > 0.5).select(
        "col1", "col2", F.concat_ws("_per_", "col1", "col2").alias("new_feature"))


def suggest_bins(df: DataFrame) -> DataFrame:
    """Numeric columns whose largest value is over 100 times the smallest."""
    span = P.long_numbers(df).groupBy("column_name").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return span.filter(F.col("high") / F.greatest(F.col("low"), F.lit(0.01)) > 100).select(
        "column_name", F.concat("column_name", F.lit("_bin")).alias("new_feature"))


def date_parts(df: DataFrame, name: str) -> DataFrame:
    """Year, month, day of week (Monday 0), quarter and weekend flag, added to the table."""
    t, day = col(name).cast("timestamp"), F.weekday(col(name).cast("timestamp"))
    return df.withColumns({
        f"{name}_year": F.year(t), f"{name}_month": F.month(t), f"{name}_day_of_week": day,
        f"{name}_quarter": F.quarter(t), f"{name}_is_weekend": day >= 5})


def ratio_feature(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn(f"{a}_per_{b}", F.try_divide(col(a).cast("double"), col(b).cast("double")))


def quantile_segments(df: DataFrame, name: str, labels: tuple[str, ...] = ("Low", "Medium", "High", "Premium")) -> DataFrame:
    """Equal-count segments; a value on a cut belongs to the lower one."""
    cuts = exact_quantiles(P.doubles(df, [name]), [name], [i / len(labels) for i in range(1, len(labels))])[name]
    v = P.as_double(df, name)
    segment = F.when(v.isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        segment = segment.when(v <= F.lit(cut), label)
    return df.withColumn(f"{name}_segment", segment.otherwise(labels[-1]))


# --------------------------------------------------------------------------- preprocessing


def preprocessing_pipeline(df: DataFrame, p: P.TableProfile, label: str | None = None) -> tuple[DataFrame, Pipeline]:
    """Table with imputed columns, and a pipeline of encoders and scalers, from the recommendations."""
    from tablewright.operators import recommend as R

    choice = {r.column_name: r.strategy for r in R.recommend_imputation(p).collect() if r.column_name != label}
    known = {"median": "median", "mean": "mean", "mode": "mode", "add_unknown": "unknown"}
    kinds = {m["column_name"]: m["kind"] for m in p.metrics}
    dropped = [c for c, s in choice.items() if s == "consider_dropping"]
    ready, _ = impute.impute(df, {c: known[s] for c, s in choice.items() if s in known and kinds[c] in ("numeric", "text")})
    ready = ready.drop(*dropped)
    stages, outputs = [], []
    encodings = {r.column_name: r.strategy for r in R.recommend_encoding(p).collect() if r.column_name not in dropped}
    for c, how in encodings.items():
        if how == "hash_encoding":
            continue
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__index", handleInvalid="keep"))
        if how == "one_hot":
            stages.append(OneHotEncoder(inputCols=[f"{c}__index"], outputCols=[f"{c}__hot"], handleInvalid="keep"))
            outputs.append(f"{c}__hot")
        elif how == "target_encoding" and label:
            stages.append(TargetEncoder(inputCols=[f"{c}__index"], outputCols=[f"{c}__target"], labelCol=label, targetType="continuous", smoothing=20.0))
            outputs.append(f"{c}__target")
        else:
            outputs.append(f"{c}__index")
    hashed = [c for c, how in encodings.items() if how == "hash_encoding"]
    if hashed:
        stages.append(FeatureHasher(inputCols=hashed, outputCol="hashed", numFeatures=256))
        outputs.append("hashed")
    scalings = {r.column_name: r.strategy for r in R.recommend_scaling(p).collect() if r.column_name not in dropped and r.column_name != label}
    for c, how in scalings.items():
        if how == "log_transform_then_standard":
            ready = ready.withColumn(c, F.log1p(F.greatest(col(c).cast("double"), F.lit(0.0))))
        stages.append(VectorAssembler(inputCols=[c], outputCol=f"{c}__vector", handleInvalid="keep"))
        scaler = RobustScaler(withCentering=True) if how == "robust_scaler" else StandardScaler(withMean=True)
        stages.append(scaler.setInputCol(f"{c}__vector").setOutputCol(f"{c}__scaled"))
        outputs.append(f"{c}__scaled")
    stages.append(VectorAssembler(inputCols=outputs, outputCol="features", handleInvalid="keep"))
    return ready, Pipeline(stages=stages)
