"""Prediction, trend, anomaly and feature checks."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from checks.common import AS_OF, LINEITEM_NUMBERS, table, union_all
from checks.preparing import _GSQL, _MODE, gaps
from checks.profiling import CORR_COLUMNS, CORR_SOURCE, correlated, pair_sql
from checks.rules import profile, scored
from tablewright.operators import predict as M
from tablewright.operators import threats as T
from tablewright.operators.profile import measure

QUERIES, ORACLES = {}, {}


def lines(s, d):
    """Lines with gaps in a number and in a flag, keyed by order and line number."""
    return table(s, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS line_id", "l_quantity", "l_discount", "l_tax", "l_partkey",
        "CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_extendedprice END AS price",
        "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_returnflag END AS flag")


QUERIES["m1_predict_missing_numeric"] = lambda s, d: M.predict_missing(lines(s, d).drop("flag"), "price", "line_id")
QUERIES["m1_prediction_summary"] = lambda s, d: M.prediction_summary(lines(s, d).drop("flag"), "price", "line_id")
QUERIES["m2_predict_missing_categorical"] = lambda s, d: M.predict_missing(lines(s, d), "flag", "line_id")
QUERIES["m3_statistical_fallback"] = lambda s, d: M.statistical_fallback(gaps(s, d), "amount")
ORACLES["m3_statistical_fallback"] = f"SELECT 'amount' AS column_name, count(*) - count(amount) AS missing_count, round(median(amount), 2) AS suggested_fill, round(avg(amount), 2) AS mean FROM {_GSQL}"
QUERIES["m3_statistical_fallback_text"] = lambda s, d: M.statistical_fallback(gaps(s, d), "prio")
ORACLES["m3_statistical_fallback_text"] = f"SELECT 'prio' AS column_name, count(*) - count(prio) AS missing_count, {_MODE} AS suggested_fill FROM {_GSQL}"
_XY = """(SELECT event_type, ts, event_id, value AS y, floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) / 86400000000) AS x FROM events)"""
_FIT = f"SELECT event_type, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, max(x) AS last_x, min(x) AS first_x FROM {_XY} GROUP BY event_type"
QUERIES["m4_linear_trend"] = lambda s, d: M.linear_trend(table(s, d, "events"), "ts", "value", ["event_type"])
ORACLES["m4_linear_trend"] = f"""SELECT event_type, n AS data_points, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(r2, 3) AS r_squared,
CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'flat' END AS direction FROM ({_FIT})"""
QUERIES["m4_linear_trend_whole"] = lambda s, d: M.linear_trend(table(s, d, "orders"), "o_orderdate", "o_totalprice")
ORACLES["m4_linear_trend_whole"] = """SELECT count(*) AS data_points, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 3) AS r_squared,
CASE WHEN regr_slope(y, x) > 0 THEN 'increasing' WHEN regr_slope(y, x) < 0 THEN 'decreasing' ELSE 'flat' END AS direction
FROM (SELECT o_totalprice AS y, floor((epoch_us(o_orderdate) - min(epoch_us(o_orderdate)) OVER ()) / 86400000000) AS x FROM orders)"""
QUERIES["m5_forecast"] = lambda s, d: M.forecast(table(s, d, "events"), "ts", "value", ["event_type"])
ORACLES["m5_forecast"] = f"""SELECT event_type, CAST(step AS INTEGER) AS step, round(slope * (last_x + (last_x - first_x) / (n - 1) * step) + intercept, 2) AS forecast FROM ({_FIT}), range(1, 11) r(step)"""
QUERIES["m6_moving_average"] = lambda s, d: M.moving_average(table(s, d, "events"), "ts", "value", "event_id", ["user_id"])
ORACLES["m6_moving_average"] = """WITH e AS (SELECT user_id, value AS y, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events),
w AS (SELECT *, CAST(CASE WHEN n > 6 THEN least(7, n // 3) ELSE 1 END AS INTEGER) AS k FROM e)
SELECT a.user_id, CAST(any_value(a.back) AS INTEGER) AS points_back, any_value(a.k) AS "window", round(sum(b.y) / any_value(a.k), 2) AS moving_average
FROM w a JOIN w b ON a.user_id = b.user_id AND b.i BETWEEN a.i - a.k + 1 AND a.i WHERE a.back <= 20 AND a.i >= a.k GROUP BY a.user_id, a.i"""
QUERIES["m7_series_summary"] = lambda s, d: M.series_summary(table(s, d, "events"), "ts", "value", "event_id", ["event_type"])
ORACLES["m7_series_summary"] = """SELECT event_type, round(avg(value), 2) AS mean, round(stddev_pop(value), 2) AS std, round(min(value), 2) AS min, round(max(value), 2) AS max,
round(arg_max(value, (ts, event_id)), 2) AS latest FROM events GROUP BY event_type"""


def isolated(s, d):
    orders = table(s, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_custkey % 50 = 0 THEN o_totalprice * 20 ELSE o_totalprice END AS price")
    return M.isolation_scores(orders, "price", "o_orderkey")


QUERIES["m8_isolation_forest"] = isolated
_SQ = "(SELECT o_orderkey, CASE WHEN o_custkey % 50 = 0 THEN o_totalprice * 20 ELSE o_totalprice END AS price FROM orders)"
QUERIES["m9_iqr_anomalies"] = lambda s, d: M.iqr_anomalies(table(s, d, "orders").selectExpr(
    "o_orderkey", "CASE WHEN o_custkey % 50 = 0 THEN o_totalprice * 20 ELSE o_totalprice END AS price"), "price", "o_orderkey")
ORACLES["m9_iqr_anomalies"] = f"""SELECT o_orderkey, round(price, 2) AS value FROM {_SQ}, (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM {_SQ})
WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)"""
QUERIES["m9_iqr_summary"] = lambda s, d: M.iqr_summary(table(s, d, "orders").selectExpr("CASE WHEN o_custkey % 50 = 0 THEN o_totalprice * 20 ELSE o_totalprice END AS price"), "price")
ORACLES["m9_iqr_summary"] = f"""WITH f AS (SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM {_SQ})),
a AS (SELECT CAST(count(*) AS DOUBLE) AS count, CAST(count(*) FILTER (WHERE price < low OR price > high) AS DOUBLE) AS anomalies, round(count(*) FILTER (WHERE price < low OR price > high) * 100.0 / count(*), 2) AS anomaly_pct,
round(avg(price), 2) AS mean, round(stddev_samp(price), 2) AS std, round(any_value(low), 2) AS lower, round(any_value(high), 2) AS upper FROM {_SQ}, f)
SELECT unnest(['count', 'anomalies', 'anomaly_pct', 'mean', 'std', 'lower', 'upper']) AS item, unnest([count, anomalies, anomaly_pct, mean, std, lower, upper]) AS value FROM a"""
QUERIES["m10_feature_correlations"] = lambda s, d: M.feature_correlations(correlated(s, d))
ORACLES["m10_feature_correlations"] = f"SELECT col1, col2, round(r, 3) AS correlation FROM ({pair_sql(CORR_COLUMNS, CORR_SOURCE)}) WHERE abs(r) > 0.3 ORDER BY abs(r) DESC, col1, col2 LIMIT 10"


def dated(s, d):
    from checks.common import dirty_orders

    return dirty_orders(s, d, "order_id", "order_date", "status", "delta", "note")


QUERIES["m11_suggest_date_parts"] = lambda s, d: M.suggest_date_parts(dated(s, d))
ORACLES["m11_suggest_date_parts"] = """SELECT 'order_date' AS column_name, 'date_decomposition' AS type, 'order_date_year,order_date_month,order_date_dayofweek,order_date_quarter' AS new_features
FROM (SELECT count(*) FILTER (WHERE o_orderkey % 6 <> 5) AS dates, count(*) AS n FROM orders) WHERE dates > n * 0.5"""
QUERIES["m12_suggest_ratios"] = lambda s, d: M.suggest_ratios(correlated(s, d))
ORACLES["m12_suggest_ratios"] = f"""SELECT col1, col2, concat(col1, '_per_', col2) AS new_feature FROM (SELECT * FROM ({pair_sql(CORR_COLUMNS, CORR_SOURCE)}) WHERE abs(r) > 0.3
ORDER BY abs(r) DESC, col1, col2 LIMIT 3) WHERE abs(round(r, 3)) > 0.5"""
QUERIES["m13_suggest_bins"] = lambda s, d: M.suggest_bins(table(s, d, "lineitem"))
ORACLES["m13_suggest_bins"] = "SELECT column_name, concat(column_name, '_bin') AS new_feature FROM (" + union_all(
    [f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM lineitem" for c in LINEITEM_NUMBERS]) + ") WHERE high / greatest(low, 0.01) > 100"
QUERIES["m14_date_parts"] = lambda s, d: M.date_parts(table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")
ORACLES["m14_date_parts"] = """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_day_of_week, CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter, isodow(o_orderdate) >= 6 AS o_orderdate_is_weekend FROM orders"""
QUERIES["m15_ratio_feature"] = lambda s, d: M.ratio_feature(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"), "l_extendedprice", "l_discount").withColumn(
    "l_extendedprice_per_l_discount", F.round("l_extendedprice_per_l_discount", 2))
ORACLES["m15_ratio_feature"] = "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, round(l_extendedprice / nullif(l_discount, 0), 2) AS l_extendedprice_per_l_discount FROM lineitem"
QUERIES["m16_quantile_segments"] = lambda s, d: M.quantile_segments(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
ORACLES["m16_quantile_segments"] = """SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice <= a THEN 'Low' WHEN o_totalprice <= b THEN 'Medium' WHEN o_totalprice <= c THEN 'High' ELSE 'Premium' END AS o_totalprice_segment
FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)"""


def preprocessed(s, d):
    source = scored(s, d).select("order_id", "status", "city", "is_urgent", "total_amount", "amount_squared")
    ready, pipeline = M.preprocessing_pipeline(source, measure(source))
    model = pipeline.fit(ready)
    return model.transform(ready).select("order_id", F.col("features").cast("string").alias("features"))


QUERIES["r5_build_preprocessing_pipeline"] = preprocessed


def neighbours(s, d):
    orders = table(s, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_custkey % 50 = 0 THEN o_totalprice * 20 ELSE o_totalprice END AS price")
    p = measure(orders)
    found = [M.neighbour_outliers(orders, c, segments=8) for c in ("price",)]
    return T.neighbour_threats(p, found).select("id", "severity", "title", "column_name", "category", "confidence")


QUERIES["t6_knn_outliers"] = neighbours
QUERIES["t6_knn_distances"] = lambda s, d: M.neighbour_distances(table(s, d, "lineitem"), "l_discount", segments=4).withColumn("distance", F.round("distance", 6))
ORACLES["t6_knn_distances"] = """WITH v AS (SELECT l_discount AS value, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT a.value, a.n, abs(a.value - b.value) AS gap, CASE WHEN a.value = b.value THEN b.n - 1 ELSE b.n END AS copies FROM v a, v b),
o AS (SELECT *, sum(copies) OVER (PARTITION BY value ORDER BY gap, copies ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - copies AS before FROM c)
SELECT value, any_value(n) AS n, round(sum(gap * greatest(0, least(copies, 10 - before))) / sum(greatest(0, least(copies, 10 - before))), 6) AS distance FROM o GROUP BY value"""
_NEAR = """(WITH v AS (SELECT price AS value, count(*) AS n, row_number() OVER (ORDER BY price) AS i FROM {src} WHERE price IS NOT NULL GROUP BY price),
c AS (SELECT a.value, a.n, abs(a.value - b.value) AS gap, CASE WHEN a.i = b.i THEN b.n - 1 ELSE b.n END AS copies FROM v a JOIN v b ON b.i BETWEEN a.i - 10 AND a.i + 10),
o AS (SELECT *, sum(copies) OVER (PARTITION BY value ORDER BY gap, copies ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - copies AS before FROM c),
d AS (SELECT value, any_value(n) AS n, sum(gap * greatest(0, least(copies, 10 - before))) / sum(greatest(0, least(copies, 10 - before))) AS distance FROM o GROUP BY value)
SELECT sum(n) AS present, sum(n) FILTER (WHERE exp(-distance / (SELECT sum(distance * n) / sum(n) FROM d)) < 0.15) AS far FROM d)"""
ORACLES["t6_knn_outliers"] = f"""SELECT 'knn_price' AS id, CASE WHEN round(far * 100.0 / present, 1) > 1 THEN 'warning' ELSE 'low' END AS severity, concat('Isolated values in price (', far, ')') AS title,
'price' AS column_name, 'Anomaly Detection' AS category, CAST(92 AS INTEGER) AS confidence FROM {_NEAR.format(src=_SQ)} WHERE far > 0"""


# A target that one feature decides: the forests must give it back exactly.
def steps(s, d):
    return table(s, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS line_id", "l_quantity", "l_partkey", "CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_quantity > 25 THEN 100.0D ELSE 10.0D END AS price",
        "CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_quantity > 25 THEN 'bulk' ELSE 'small' END AS kind")


QUERIES["m1_predict_step"] = lambda s, d: M.predict_missing(steps(s, d).drop("kind"), "price", "line_id")
ORACLES["m1_predict_step"] = "SELECT l_orderkey * 10 + l_linenumber AS line_id, CASE WHEN l_quantity > 25 THEN 100.0::DOUBLE ELSE 10.0 END AS predicted_value FROM lineitem WHERE l_orderkey % 17 = 0"
QUERIES["m2_predict_step"] = lambda s, d: M.predict_missing(steps(s, d).drop("price"), "kind", "line_id")
ORACLES["m2_predict_step"] = "SELECT l_orderkey * 10 + l_linenumber AS line_id, CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'small' END AS predicted_value FROM lineitem WHERE l_orderkey % 17 = 0"


def far_away(s, d):
    """Every planted far value must be among the five in a hundred that are flagged."""
    orders = table(s, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 64 = 0 THEN o_totalprice + 1e8 ELSE o_totalprice END AS price")
    return M.isolation_scores(orders, "price", "o_orderkey").agg(
        F.count("*").alias("rows"), F.count_if(F.col("value") > 5e7).alias("planted"), F.count_if((F.col("value") > 5e7) & F.col("anomaly")).alias("planted_found"),
        F.count_if("anomaly").cast("double").between(F.lit(0), F.count("*") * 0.0501).alias("flagged_in_share"))


QUERIES["m8_isolation_planted"] = far_away
ORACLES["m8_isolation_planted"] = """SELECT count(*) AS "rows", count(*) FILTER (WHERE o_orderkey % 64 = 0) AS planted, count(*) FILTER (WHERE o_orderkey % 64 = 0) AS planted_found, true AS flagged_in_share FROM orders"""
