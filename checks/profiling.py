"""Profiling checks."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from checks.common import (DIRTY_ORDERS, LINEITEM_NUMBERS, dirty_orders, dirty_orders_sql, quoted, table, union_all)
from tablewright.functions import constants as C
from tablewright.operators import impute
from tablewright.operators import profile as P
from tablewright.session import cut_lineage

QUERIES, ORACLES = {}, {}
DIRTY_TEXT = ["customer_ref", "status", "priority", "price_text", "is_urgent", "city", "delta", "note"]
DIRTY_MIX = ["order_id", "customer_ref", "status", "total_amount", "discount_text", "city", "reference"]


def over(columns, select, source):
    """One SELECT per column, the column standing as {c} and its name as {n}."""
    return union_all([f"SELECT {quoted(c)} AS column_name, " + select.replace("{c}", c) + f" FROM {source}" for c in columns])


STRIPPED = f"trim({{c}}, {quoted(C.SPACE_CHARACTERS)})"
LOOKS_NUMERIC = (f"regexp_matches(trim(translate({{c}}, ',$₹%', ''), {quoted(C.SPACE_CHARACTERS)}), "
                 f"{quoted(C.NUMBER)})")
CARDINALITY = ("CASE WHEN {d} <= 2 THEN 'Binary' WHEN {d} <= 10 THEN 'Low' WHEN {d} <= 50 THEN 'Moderate' "
               "WHEN {d} >= {n} * 0.9 THEN 'ID' ELSE 'High' END")
MISSING_MIX = over(DIRTY_MIX, "count(*) AS n, count(*) - count({c}) AS missing", f"({dirty_orders_sql(*DIRTY_MIX)})")

QUERIES["p1_overview"] = lambda s, d: P.overview(dirty_orders(s, d, *DIRTY_MIX))
ORACLES["p1_overview"] = f"""
WITH t AS ({dirty_orders_sql(*DIRTY_MIX)}),
m AS (SELECT count(*) AS n, {' + '.join(f'count(*) - count({c})' for c in DIRTY_MIX)} AS missing FROM t),
u AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM t))
SELECT m.n AS "rows", CAST(7 AS BIGINT) AS cols, CAST(2 AS BIGINT) AS numeric_columns, CAST(5 AS BIGINT) AS text_columns,
CAST(0 AS BIGINT) AS datetime_columns, CAST(missing AS BIGINT) AS total_missing,
round(missing * 100.0 / (m.n * 7), 2) AS total_missing_pct, m.n - u.n AS total_duplicates FROM m, u"""

QUERIES["p2_missing_by_column"] = lambda s, d: P.missing_by_column(dirty_orders(s, d, *DIRTY_MIX))
ORACLES["p2_missing_by_column"] = f"""
SELECT column_name, missing, round(missing * 100.0 / n, 2) AS missing_pct,
CASE WHEN missing / n > 0.3 THEN 'critical' WHEN missing / n > 0.05 THEN 'warning' ELSE 'low' END AS severity
FROM ({MISSING_MIX}) WHERE missing > 0"""

_ALL_LINE = LINEITEM_NUMBERS + ["l_returnflag", "l_linestatus", "l_shipdate"]
_DISTINCT = over(_ALL_LINE, "count(DISTINCT {c}) AS d, count(*) AS n", "lineitem")
QUERIES["p3_distinct_count"] = lambda s, d: P.distinct_counts(table(s, d, "lineitem")).select(
    "column_name", "distinct", "distinct_pct")
ORACLES["p3_distinct_count"] = f"""SELECT column_name, d AS "distinct", round(d * 100.0 / n, 2) AS distinct_pct FROM ({_DISTINCT})"""
QUERIES["p4_cardinality_class"] = lambda s, d: P.distinct_counts(table(s, d, "lineitem")).select("column_name", "cardinality")
ORACLES["p4_cardinality_class"] = f"SELECT column_name, {CARDINALITY.format(d='d', n='n')} AS cardinality FROM ({_DISTINCT})"

_NUMERIC = (
    "round(avg({c}), 2) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 2) AS median, round(stddev_samp({c}), 2) AS std, "
    "round(CAST(min({c}) AS DOUBLE), 2) AS min, round(CAST(max({c}) AS DOUBLE), 2) AS max, "
    "round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 2) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 2) AS q3, "
    "round(skewness({c}), 3) + 0 AS skewness, round(kurtosis({c}), 3) + 0 AS kurtosis")
QUERIES["p5_numeric_stats"] = lambda s, d: P.numeric_stats(table(s, d, "lineitem"))
ORACLES["p5_numeric_stats"] = over(LINEITEM_NUMBERS, _NUMERIC, "lineitem")

_SKEWED = "SELECT l_orderkey, l_extendedprice * l_extendedprice * l_quantity AS squared, l_quantity FROM lineitem"
_FENCE = ("count({c}) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3")


def fences(columns, source, reach="1.5"):
    return union_all([
        f"SELECT '{c}' AS column_name, n, q1 - {reach} * (q3 - q1) AS lo, q3 + {reach} * (q3 - q1) AS hi, "
        f"(SELECT count(*) FROM {source} WHERE {c} < q1 - {reach} * (q3 - q1) OR {c} > q3 + {reach} * (q3 - q1)) AS outliers "
        f"FROM (SELECT count({c}) AS n, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source})" for c in columns])


def skewed(s, d):
    return table(s, d, "lineitem").selectExpr(
        "l_orderkey", "l_extendedprice * l_extendedprice * l_quantity AS squared", "l_quantity")


def merged_batches(s, d):
    """Lines in three batches, each measured once and stored as states; the whole from the states alone."""
    lines = table(s, d, "lineitem")
    states = [cut_lineage(P.column_states(lines.filter(f"l_orderkey % 3 = {k}"))) for k in range(3)]
    whole = P.merge_states(states[0].unionByName(states[1]).unionByName(states[2]))
    return whole.select("column_name", "rows", "present", *[F.round(c, 2).alias(c) for c in ("mean", "std", "min", "max")], *[(F.round(c, 3) + 0).alias(c) for c in ("skewness", "kurtosis")])


QUERIES["p14_states_of_batches"] = merged_batches
ORACLES["p14_states_of_batches"] = over(LINEITEM_NUMBERS, "count(*) AS rows, count({c}) AS present, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, round(CAST(min({c}) AS DOUBLE), 2) AS min, "
                                        "round(CAST(max({c}) AS DOUBLE), 2) AS max, round(skewness({c}), 3) + 0 AS skewness, round(kurtosis({c}), 3) + 0 AS kurtosis", "lineitem")
QUERIES["p6_iqr_outliers"] = lambda s, d: P.iqr_outliers(skewed(s, d))
ORACLES["p6_iqr_outliers"] = f"""SELECT column_name, outliers, round(outliers * 100.0 / n, 2) AS outlier_pct,
round(lo, 2) AS lower_bound, round(hi, 2) AS upper_bound FROM ({fences(['l_orderkey', 'squared', 'l_quantity'], f'({_SKEWED})')})"""

QUERIES["p7_distribution_shape"] = lambda s, d: P.distribution_shapes(skewed(s, d))
ORACLES["p7_distribution_shape"] = (
    "SELECT column_name, CASE WHEN sk IS NULL THEN 'unknown' WHEN abs(sk) < 0.5 THEN 'approximately_normal' "
    "WHEN sk > 0.5 THEN 'right_skewed' ELSE 'left_skewed' END AS distribution FROM ("
    + over(["l_orderkey", "squared", "l_quantity"], "skewness({c}) AS sk", f"({_SKEWED})") + ")")


def ranked_values(columns, source, k, order="DESC"):
    return union_all([
        f"SELECT '{c}' AS column_name, rank, value, n FROM (SELECT CAST(row_number() OVER (ORDER BY n {order}, value) AS INTEGER) AS rank, "
        f"value, n FROM (SELECT {c} AS value, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})) WHERE rank <= {k}"
        for c in columns])


_DIRTY_TEXT_SQL = f"({dirty_orders_sql(*DIRTY_TEXT)})"
QUERIES["p8_top_values"] = lambda s, d: P.top_values(dirty_orders(s, d, *DIRTY_TEXT))
ORACLES["p8_top_values"] = ranked_values(DIRTY_TEXT, _DIRTY_TEXT_SQL, 5)


def top_documents(s, d):
    docs = table(s, d, "documents").select("text", "lang", "source")
    return P.restore_long_values(docs, P.top_values(docs))


QUERIES["p8_top_values_long_text"] = top_documents
ORACLES["p8_top_values_long_text"] = union_all([
    f"SELECT '{c}' AS column_name, rank, value, n FROM (SELECT CAST(row_number() OVER (ORDER BY n DESC, key) AS INTEGER) AS rank, "
    f"value, n FROM (SELECT {c} AS value, CASE WHEN length({c}) > 40 THEN concat('md5:', md5({c})) ELSE {c} END AS key, "
    f"count(*) AS n FROM documents GROUP BY {c})) WHERE rank <= 5" for c in ("text", "lang", "source")])

QUERIES["p9_mode_frequency"] = lambda s, d: P.mode_frequency(dirty_orders(s, d, *DIRTY_TEXT))
ORACLES["p9_mode_frequency"] = union_all([
    f"SELECT '{c}' AS column_name, value AS mode, round(n * 100.0 / total, 2) AS mode_frequency FROM (SELECT value, n, "
    f"sum(n) OVER () AS total, row_number() OVER (ORDER BY n DESC, value) AS rank FROM (SELECT {c} AS value, count(*) AS n "
    f"FROM {_DIRTY_TEXT_SQL} WHERE {c} IS NOT NULL GROUP BY {c})) WHERE rank = 1" for c in DIRTY_TEXT])

_LIKE = over(DIRTY_TEXT, "count({c}) AS n, count(*) FILTER (WHERE " + LOOKS_NUMERIC + ") AS k", _DIRTY_TEXT_SQL)
QUERIES["p10_mixed_type_flag"] = lambda s, d: P.mixed_type_flags(dirty_orders(s, d, *DIRTY_TEXT))
ORACLES["p10_mixed_type_flag"] = f"""SELECT column_name, k AS numeric_like, round(k * 100.0 / n, 1) AS numeric_parseable_pct,
k > 0 AND k < n * 0.8 AS mixed_types FROM ({_LIKE})"""


def numeric_looking_values(s, d):
    from pyspark.sql import functions as F

    from tablewright.functions.text import numeric_looking

    t = dirty_orders(s, d, "order_id", "price_text", "delta", "discount_text")
    return t.select("order_id", *[F.coalesce(numeric_looking(F.col(c)), F.lit(False)).alias(c)
                                  for c in ("price_text", "delta", "discount_text")])


QUERIES["p11_numeric_looking"] = numeric_looking_values
ORACLES["p11_numeric_looking"] = "SELECT order_id, " + ", ".join(
    f"coalesce({LOOKS_NUMERIC.replace("{c}", c)}, false) AS {c}" for c in ("price_text", "delta", "discount_text")
) + f" FROM ({dirty_orders_sql('order_id', 'price_text', 'delta', 'discount_text')})"

_DUP = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"]
DUPLICATES_SQL = """SELECT n - u AS exact_duplicates, round((n - u) * 100.0 / n, 2) AS duplicate_pct,
CASE WHEN (n - u) / n > 0.05 THEN 'critical' WHEN n > u THEN 'warning' ELSE 'none' END AS severity
FROM (SELECT (SELECT count(*) FROM {t}) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS u)"""
QUERIES["p12_duplicate_summary"] = lambda s, d: P.duplicate_summary(table(s, d, "lineitem").select(*_DUP))
ORACLES["p12_duplicate_summary"] = DUPLICATES_SQL.format(t=f"(SELECT {', '.join(_DUP)} FROM lineitem)")
QUERIES["p12_duplicate_documents"] = lambda s, d: P.duplicate_summary(table(s, d, "documents").select("text", "lang"))
ORACLES["p12_duplicate_documents"] = DUPLICATES_SQL.format(t="(SELECT text, lang FROM documents)")


def pair_sql(columns, source):
    return union_all([f"SELECT '{a}' AS col1, '{b}' AS col2, corr({a}, {b}) AS r FROM {source}"
                      for a, b in itertools.combinations(columns, 2)])


CORR_COLUMNS = ["order_id", "l_quantity", "l_extendedprice", "taxed", "half", "l_discount"]
_CORR_EXPR = ("l_orderkey AS order_id, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice, "
              "l_extendedprice * (1 + l_tax) AS taxed, l_quantity + l_discount * 50 AS half, l_discount")
CORR_SOURCE = f"(SELECT {_CORR_EXPR} FROM lineitem)"


def correlated(s, d):
    table(s, d, "lineitem").createOrReplaceTempView("lineitem_rows")
    return s.sql(f"SELECT {_CORR_EXPR} FROM lineitem_rows")


QUERIES["p13_correlation_pairs"] = lambda s, d: P.correlation_pairs(correlated(s, d))
ORACLES["p13_correlation_pairs"] = f"""SELECT col1, col2, round(r, 3) AS correlation, CASE WHEN abs(r) > 0.95 THEN 'critical'
WHEN abs(r) > 0.85 THEN 'warning' ELSE 'info' END AS severity FROM ({pair_sql(CORR_COLUMNS, CORR_SOURCE)}) WHERE abs(r) > 0.7"""


def profile_sql(columns: dict[str, str], source: str) -> str:
    """The full profile of named columns (name -> kind) of a source."""
    parts = []
    for c, kind in columns.items():
        num = kind == "numeric"
        stat = {k: (e if num else "CAST(NULL AS DOUBLE)") for k, e in {
            "mean": f"avg({c})", "median": f"quantile_cont(CAST({c} AS DOUBLE), 0.5)", "std": f"stddev_samp({c})",
            "min": f"CAST(min({c}) AS DOUBLE)", "max": f"CAST(max({c}) AS DOUBLE)",
            "q1": f"quantile_cont(CAST({c} AS DOUBLE), 0.25)", "q3": f"quantile_cont(CAST({c} AS DOUBLE), 0.75)",
            "sk": f"skewness({c})", "ku": f"kurtosis({c})"}.items()} if num else {
            k: "CAST(NULL AS DOUBLE)" for k in ("mean", "median", "std", "min", "max", "q1", "q3", "sk", "ku")}
        outliers = (f"(SELECT count(*) FROM {source} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"
                    if num else "CAST(NULL AS BIGINT)")
        mode = (f"(SELECT {{}} FROM (SELECT {c} AS value, count(*) AS k FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) "
                f"ORDER BY k DESC, value LIMIT 1)")
        mode_value, mode_count = (mode.format("value"), mode.format("k")) if kind == "text" else ("CAST(NULL AS VARCHAR)", "CAST(NULL AS BIGINT)")
        parts.append(
            f"SELECT '{c}' AS column_name, '{kind}' AS kind, n - present AS missing, round((n - present) * 100.0 / n, 2) AS missing_pct, "
            f"d AS \"distinct\", round(d * 100.0 / n, 2) AS distinct_pct, {CARDINALITY.format(d='d', n='n')} AS cardinality, "
            "round(mean, 2) AS mean, round(median, 2) AS median, round(std, 2) AS std, round(min, 2) AS min, round(max, 2) AS max, "
            "round(q1, 2) AS q1, round(q3, 2) AS q3, round(sk, 3) + 0 AS skewness, round(ku, 3) + 0 AS kurtosis, "
            f"{outliers} AS outliers, round({outliers} * 100.0 / present, 2) AS outlier_pct, "
            + ("CASE WHEN sk IS NULL THEN 'unknown' WHEN abs(sk) < 0.5 THEN 'approximately_normal' WHEN sk > 0.5 THEN 'right_skewed' "
               "ELSE 'left_skewed' END" if num else "CAST(NULL AS VARCHAR)") + " AS distribution, "
            f"{mode_value} AS mode, round({mode_count} * 100.0 / present, 2) AS mode_frequency "
            f"FROM (SELECT count(*) AS n, count({c}) AS present, count(DISTINCT {c}) AS d, "
            + ", ".join(f"{e} AS {k}" for k, e in stat.items()) + f" FROM {source})")
    return union_all(parts)


PROFILE_KINDS = {"order_id": "numeric", "customer_ref": "text", "status": "text", "total_amount": "numeric",
                 "is_urgent": "text", "city": "text"}
PROFILE_SOURCE = f"({dirty_orders_sql(*PROFILE_KINDS)})"
QUERIES["p14_full_profile"] = lambda s, d: P.full_profile(dirty_orders(s, d, *PROFILE_KINDS))
ORACLES["p14_full_profile"] = profile_sql(PROFILE_KINDS, PROFILE_SOURCE)
LINE_KINDS = {**{c: "numeric" for c in LINEITEM_NUMBERS}, "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "datetime"}
QUERIES["p14_full_profile_lineitem"] = lambda s, d: P.full_profile(table(s, d, "lineitem"))
ORACLES["p14_full_profile_lineitem"] = profile_sql(LINE_KINDS, "lineitem")


# Not-a-number counts as missing --------------------------------------------------------------
def with_nan(s, d):
    return table(s, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN double('NaN') WHEN o_orderkey % 11 = 0 THEN NULL ELSE double(o_totalprice) END AS price")


_NAN = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS price FROM orders)"
QUERIES["p2_missing_with_nan"] = lambda s, d: P.missing_by_column(with_nan(s, d))
ORACLES["p2_missing_with_nan"] = f"""SELECT 'price' AS column_name, count(*) - count(price) AS missing, round((count(*) - count(price)) * 100.0 / count(*), 2) AS missing_pct,
CASE WHEN (count(*) - count(price)) / count(*) > 0.3 THEN 'critical' WHEN (count(*) - count(price)) / count(*) > 0.05 THEN 'warning' ELSE 'low' END AS severity FROM {_NAN}"""
QUERIES["i6_impute_median_with_nan"] = lambda s, d: impute.impute_with(with_nan(s, d), "median_indicator", ["price"]).withColumn("price", F.round("price", 4))
ORACLES["i6_impute_median_with_nan"] = f"""SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM {_NAN})), 4) AS price, CAST(price IS NULL AS INTEGER) AS price_was_missing FROM {_NAN}"""
