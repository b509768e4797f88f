"""Imputation, ordered fills, pipelines and before/after checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import cleaning as K
from checks.cleaning import fuzzy_sql
from checks.common import AS_OF, DIRTY_ORDERS, dirty_orders, dirty_orders_sql, quoted, table, union_all
from checks.profiling import fences
from checks.rules import ALL, RATED, SRC, comparison_sql, profile, scored
from tablewright.functions import constants as C
from tablewright.operators import cleaners as X
from tablewright.operators import impute as I
from tablewright.operators import profile as P
from tablewright.plans import cleaning, pipeline

QUERIES, ORACLES = {}, {}

# Orders with text dates and years under date-like names.
_NAMED = {"order_id": "o_orderkey", "order_date": DIRTY_ORDERS["order_date"],
          "fiscal_period": "CASE WHEN o_orderkey % 2 = 0 THEN concat(cast(year(o_orderdate) AS STRING), '.0') ELSE cast(year(o_orderdate) AS STRING) END"}
_NAMED_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _NAMED.items()) + " FROM orders)"


def named(s, d):
    return table(s, d, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _NAMED.items()])


QUERIES["i1_parse_year_columns"] = lambda s, d: cleaning.run_cleaners(named(s, d).select("order_id", "fiscal_period"), [X.PARSE_YEARS])[0]
ORACLES["i1_parse_year_columns"] = f"SELECT order_id, CAST(TRY_CAST(regexp_replace(fiscal_period, '\\.0$', '') AS DOUBLE) AS BIGINT) AS fiscal_period FROM {_NAMED_SQL}"
QUERIES["i2_parse_date_columns"] = lambda s, d: cleaning.run_cleaners(named(s, d).select("order_id", "order_date"), X.DATE_FIXES)[0]
ORACLES["i2_parse_date_columns"] = f"SELECT order_id, {K.dates('order_date')} AS order_date FROM {_NAMED_SQL}"
_FLAGS = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"]
QUERIES["i3_remove_duplicates"] = lambda s, d: I.remove_duplicates(table(s, d, "lineitem").select(*_FLAGS))
ORACLES["i3_remove_duplicates"] = f"SELECT DISTINCT {', '.join(_FLAGS)} FROM lineitem"
QUERIES["i3_remove_duplicate_documents"] = lambda s, d: I.remove_duplicates(table(s, d, "documents").select("text", "lang", "n_chars"))
ORACLES["i3_remove_duplicate_documents"] = "SELECT DISTINCT text, lang, n_chars FROM documents"
_CASE = ["order_id", "status", "city", "note", "customer_ref"]


def title(x):
    """A capital for the first letter of every run of letters, the rest lower."""
    return f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|\\P{{L}}+'), lambda w: concat(upper(w[1]), lower(w[2:]))), '')"


QUERIES["i4_standardize_case"] = lambda s, d: I.standardize_case(dirty_orders(s, d, *_CASE))[0]
ORACLES["i4_standardize_case"] = f"SELECT order_id, {title('trim(status)')} AS status, {title('trim(city)')} AS city, note, customer_ref FROM ({dirty_orders_sql(*_CASE)})"
QUERIES["i5_choose_imputation"] = lambda s, d: I.choose_imputation(profile(s, d))
ORACLES["i5_choose_imputation"] = f"""SELECT column_name, miss AS missing_pct, CASE WHEN kind = 'numeric' AND miss > 50 THEN 'median_indicator' WHEN kind = 'numeric' AND miss < 30 AND abs(coalesce(sk, 0)) > 1 THEN 'median'
 WHEN kind = 'numeric' AND miss < 30 THEN 'mean' WHEN kind = 'numeric' OR miss > 50 THEN 'skip' WHEN kind = 'text' AND miss < 20 AND card IN ('Low', 'Binary', 'Moderate') THEN 'mode'
 WHEN kind = 'text' AND miss < 30 THEN 'unknown' ELSE 'skip' END AS strategy FROM {RATED} WHERE miss > 0"""

# Numbers and text with gaps.
_GAPS = {"order_id": "o_orderkey", "amount": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END",
         "cust": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END",
         "rare": "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE NULL END",
         "prio": "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderpriority END"}
_GSQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _GAPS.items()) + " FROM orders)"


def gaps(s, d):
    return table(s, d, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _GAPS.items()])


_MODE = f"(SELECT prio FROM {_GSQL} WHERE prio IS NOT NULL GROUP BY prio ORDER BY count(*) DESC, prio LIMIT 1)"
QUERIES["i6_impute_median"] = lambda s, d: I.impute_with(gaps(s, d), "median", ["amount", "rare"])
ORACLES["i6_impute_median"] = f"SELECT order_id, coalesce(amount, (SELECT median(amount) FROM {_GSQL})) AS amount, cust, coalesce(rare, (SELECT median(rare) FROM {_GSQL})) AS rare, prio FROM {_GSQL}"
QUERIES["i7_impute_mean"] = lambda s, d: I.impute_with(gaps(s, d), "mean", ["amount", "cust"]).withColumn("amount", F.round("amount", 4)).withColumn("cust", F.round("cust", 4))
ORACLES["i7_impute_mean"] = f"SELECT order_id, round(coalesce(amount, (SELECT avg(amount) FROM {_GSQL})), 4) AS amount, round(coalesce(CAST(cust AS DOUBLE), (SELECT avg(cust) FROM {_GSQL})), 4) AS cust, rare, prio FROM {_GSQL}"
QUERIES["i8_impute_mode"] = lambda s, d: I.impute_with(gaps(s, d), "mode", ["prio"])
ORACLES["i8_impute_mode"] = f"SELECT order_id, amount, cust, rare, coalesce(prio, {_MODE}) AS prio FROM {_GSQL}"
QUERIES["i9_impute_constant"] = lambda s, d: I.impute(gaps(s, d), {"cust": "zero", "prio": "unknown"})[0]
ORACLES["i9_impute_constant"] = f"SELECT order_id, amount, coalesce(cust, 0) AS cust, rare, coalesce(prio, 'Unknown') AS prio FROM {_GSQL}"
QUERIES["i10_impute_median_with_indicator"] = lambda s, d: I.impute_with(gaps(s, d), "median_indicator", ["rare"])
ORACLES["i10_impute_median_with_indicator"] = f"SELECT order_id, amount, cust, coalesce(rare, (SELECT median(rare) FROM {_GSQL})) AS rare, prio, CAST(rare IS NULL AS INTEGER) AS rare_was_missing FROM {_GSQL}"

_WIDE = {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "spread": "l_extendedprice * l_quantity",
         "burst": "CASE WHEN l_partkey % 25 = 0 THEN l_partkey * 1000 ELSE l_partkey % 40 END"}
_WSQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _WIDE.items()) + " FROM lineitem)"
QUERIES["i11_winsorize"] = lambda s, d: I.winsorize(table(s, d, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _WIDE.items()]))[0].withColumn("spread", F.round("spread", 4))
ORACLES["i11_winsorize"] = f"""WITH q AS (SELECT quantile_cont(spread, 0.01) AS a, quantile_cont(spread, 0.99) AS b, round_even(quantile_cont(CAST(burst AS DOUBLE), 0.01), 0) AS c,
round_even(quantile_cont(CAST(burst AS DOUBLE), 0.99), 0) AS d FROM {_WSQL}),
g AS (SELECT max(column_name = 'spread' AND pct > 2) AS s, max(column_name = 'burst' AND pct > 2) AS t FROM (SELECT column_name, round(outliers * 100.0 / n, 2) AS pct FROM ({fences(['spread', 'burst'], _WSQL)})))
SELECT l_orderkey, l_linenumber, round(CASE WHEN g.s THEN least(greatest(spread, a), b) ELSE spread END, 4) AS spread, CAST(CASE WHEN g.t THEN least(greatest(burst, c), d) ELSE burst END AS BIGINT) AS burst FROM {_WSQL}, q, g"""
_EV = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events)"


def gappy_events(s, d):
    return table(s, d, "events").selectExpr("event_id", "user_id", "ts", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value")


QUERIES["i12_forward_fill"] = lambda s, d: I.forward_fill(gappy_events(s, d), "ts", "event_id", ["user_id"], ["value"], segments=16)
ORACLES["i12_forward_fill"] = f"SELECT event_id, user_id, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {_EV}"


def filled_audit(s, d):
    """The audit of a sorted fill, and none for a column whose order is not steady."""
    events = gappy_events(s, d).withColumn("moment", F.col("event_id") * 2)
    _, audit = I.forward_fill_sorted(events, "moment", "event_id", ["user_id"], columns=["value"], segments=16)
    _, none = I.forward_fill_sorted(events.withColumn("unsteady", F.col("event_id") % 7), "unsteady", "event_id", ["user_id"], columns=["value"], segments=16)
    return cleaning.audit_frame(s, audit + none).select("action", "column_name", "rows_affected", "confidence")


QUERIES["i12_forward_fill_audit"] = filled_audit
ORACLES["i12_forward_fill_audit"] = f"""SELECT 'FORWARD_FILL' AS action, 'value' AS column_name, count(*) FILTER (WHERE value IS NULL AND before IS NOT NULL) AS rows_affected, CAST(82 AS INTEGER) AS confidence
FROM (SELECT value, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before FROM {_EV})"""


def monotonic(s, d):
    events, orders = table(s, d, "events"), table(s, d, "orders")
    return (I.monotonic_check(events, "ts", "event_id", 16).withColumn("table_name", F.lit("events"))
            .unionByName(I.monotonic_check(orders, "o_orderdate", "o_orderkey", 16).withColumn("table_name", F.lit("orders"))))


QUERIES["i13_monotonic_check"] = monotonic
_MONO = ("SELECT '{t}' AS table_name, count(*) FILTER (WHERE v > p) AS increases, count(*) FILTER (WHERE v < p) AS decreases, count(*) FILTER (WHERE v < p) = 0 AS non_decreasing, "
         "count(*) FILTER (WHERE v > p) = 0 AS non_increasing FROM (SELECT {v} AS v, lag({v}) OVER (ORDER BY {k}) AS p FROM {t})")
ORACLES["i13_monotonic_check"] = union_all([_MONO.format(t="events", v="ts", k="event_id"), _MONO.format(t="orders", v="o_orderdate", k="o_orderkey")])

# Pipelines -----------------------------------------------------------------------------------
_AUTO = ["order_id", "customer_ref", "status", "total_amount", "price_text", "is_urgent", "note", "city", "reference"]
_ASQL = f"({dirty_orders_sql(*_AUTO)})"
QUERIES["i14_auto_clean"] = lambda s, d: pipeline.auto_clean(dirty_orders(s, d, *_AUTO)).table.withColumn(
    "total_amount", F.round("total_amount", 4)).withColumn("price_text", F.round("price_text", 4))
_STAGED = f"""SELECT order_id, {K.base('customer_ref')} AS customer_ref, {title(K.base('status'))} AS status, total_amount,
{K.currency(K.base('price_text'))} AS price_text, {K.boolean(K.base('is_urgent'))} AS is_urgent, {K.mojibake(K.marks(K.base('note')))} AS note, {title(K.base('city'))} AS city FROM {_ASQL}"""
ORACLES["i14_auto_clean"] = f"""WITH t AS (SELECT DISTINCT * FROM ({_STAGED}))
SELECT order_id, coalesce(customer_ref, 'Unknown') AS customer_ref, coalesce(status, (SELECT status FROM t WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status,
round(coalesce(total_amount, (SELECT avg(total_amount) FROM t)), 4) AS total_amount, round(coalesce(price_text, (SELECT avg(price_text) FROM t)), 4) AS price_text, is_urgent, note, city FROM t"""
# A table of numbers alone, with copies and gaps.
_PLAIN = "SELECT o_custkey AS cust, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS amount, o_orderkey % 5 AS k FROM orders"
_TWICE = f"({_PLAIN} UNION ALL {_PLAIN} WHERE o_orderkey % 7 = 0)"


def numbers_alone(s, d):
    plain = table(s, d, "orders").selectExpr("o_orderkey", "o_custkey AS cust", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS amount", "o_orderkey % 5 AS k")
    return plain.drop("o_orderkey").unionByName(plain.filter("o_orderkey % 7 = 0").drop("o_orderkey"))


QUERIES["i14_auto_clean_numeric"] = lambda s, d: pipeline.auto_clean(numbers_alone(s, d)).table.withColumn("amount", F.round("amount", 4))
ORACLES["i14_auto_clean_numeric"] = f"""WITH t AS (SELECT DISTINCT * FROM {_TWICE}) SELECT cust, round(coalesce(amount, (SELECT CASE WHEN abs(round(skewness(amount), 3)) > 1 THEN median(amount) ELSE avg(amount) END FROM t)), 4) AS amount, k FROM t"""
_ACTIONS = [{"type": "impute_median", "column": "amount"}, {"type": "impute_mode", "column": "prio"}, {"type": "standardize_case", "column": "prio"},
            {"type": "drop_column", "column": "rare"}, {"type": "drop_column", "column": "order_id"}, {"type": "remove_duplicates"}]
QUERIES["i15_transform_actions"] = lambda s, d: pipeline.transform_actions(gaps(s, d), _ACTIONS)
ORACLES["i15_transform_actions"] = f"SELECT DISTINCT coalesce(amount, (SELECT median(amount) FROM {_GSQL})) AS amount, cust, {title(f'trim(coalesce(prio, {_MODE}))')} AS prio FROM {_GSQL}"


def compared(s, d):
    """The scored table before and after case and gaps are mended, a column dropped and one added: all sections."""
    before = scored(s, d)
    after = I.impute_with(I.standardize_case(before)[0], "median", ["total_amount"]).drop("city").withColumn("flag", F.col("status").isNull().cast("int"))
    return pipeline.compare_profiles(P.measure(before), P.measure(after), AS_OF)


QUERIES["i16_compare_profiles"] = compared
_AFTER_KINDS = {c: k for c, k in ALL.items() if c != "city"} | {"flag": "numeric"}
_AFTER = "(SELECT " + ", ".join({"status": f"{title('trim(status)')} AS status", "total_amount": f"coalesce(total_amount, (SELECT median(total_amount) FROM {SRC})) AS total_amount",
                                 "flag": "CAST(status IS NULL AS INTEGER) AS flag"}.get(c, c) for c in _AFTER_KINDS) + f" FROM {SRC})"
ORACLES["i16_compare_profiles"] = comparison_sql(ALL, SRC, _AFTER_KINDS, _AFTER, "order_date")


def iterated(s, d):
    session = pipeline.Session(dirty_orders(s, d, *_AUTO), AS_OF)
    return session.iterate(pipeline.auto_clean)


QUERIES["i17_iterate"] = iterated
_AUTO_KINDS = {c: "numeric" if c in ("order_id", "total_amount") else "text" for c in _AUTO}
_CLEAN_KINDS = {c: k for c, k in _AUTO_KINDS.items() if c != "reference"} | {"price_text": "numeric", "is_urgent": "boolean"}
ORACLES["i17_iterate"] = comparison_sql(_AUTO_KINDS, _ASQL, _CLEAN_KINDS, f"({ORACLES['i14_auto_clean']})")


def trail(s, d):
    result = pipeline.auto_clean(dirty_orders(s, d, *_AUTO))
    return cleaning.audit_frame(s, result.audit).select("action", "column_name", "rows_affected", "confidence")


QUERIES["i18_audit_trail"] = trail
_T = _STAGED
ORACLES["i18_audit_trail"] = f"""WITH r AS (SELECT * FROM {_ASQL}), t AS ({_STAGED})
SELECT 'CLEAN_NULL_STRINGS' AS action, 'status' AS column_name, count(*) FILTER (WHERE {K.nullify('status')} IS NULL) AS rows_affected, CAST(96 AS INTEGER) AS confidence FROM r
UNION ALL SELECT 'CLEAN_NULL_STRINGS', 'price_text', count(*) FILTER (WHERE {K.nullify('price_text')} IS NULL), 96 FROM r
UNION ALL SELECT 'CLEAN_WHITESPACE', 'city', count(*) FILTER (WHERE {K.space('city')} <> city), 98 FROM r
UNION ALL SELECT 'NORMALIZE_BOOLEANS', 'is_urgent', count(is_urgent), 93 FROM t
UNION ALL SELECT 'PARSE_CURRENCY', 'price_text', count(price_text), 95 FROM t
UNION ALL SELECT 'STRIP_REFERENCES', 'note', count(*) FILTER (WHERE {K.marks('note')} <> note), 92 FROM r
UNION ALL SELECT 'FIX_ENCODING', 'note', count(*) FILTER (WHERE {K.mojibake('note')} <> note), 95 FROM r
UNION ALL SELECT 'DROP_EMPTY_REFERENCE_COLUMN', 'reference', 0, 90
UNION ALL SELECT 'STANDARDIZE_CASE', 'status', count(status), 94 FROM t
UNION ALL SELECT 'STANDARDIZE_CASE', 'city', count(city), 94 FROM t
UNION ALL SELECT 'IMPUTE_UNKNOWN', 'customer_ref', count(*) - count(customer_ref), 82 FROM t
UNION ALL SELECT 'IMPUTE_MODE', 'status', count(*) - count(status), 86 FROM t
UNION ALL SELECT 'IMPUTE_MEAN', 'total_amount', count(*) - count(total_amount), 88 FROM t
UNION ALL SELECT 'IMPUTE_MEAN', 'price_text', count(*) - count(price_text), 88 FROM t
UNION ALL SELECT 'SKIP_COLUMN', 'is_urgent', 0, 70"""


# X18 over the same view, merging by similarity included.
QUERIES["x18_auto_correct"] = lambda s, d: pipeline.auto_correct(dirty_orders(s, d, *_AUTO)).table
_X18 = f"""SELECT order_id, {K.base('customer_ref')} AS customer_ref, {K.base('status')} AS status, total_amount, {K.currency(K.base('price_text'))} AS price_text,
{K.boolean(K.base('is_urgent'))} AS is_urgent, {K.marks(K.base(K.mojibake('note')))} AS note, {K.base('city')} AS city FROM {_ASQL}"""
_CANON = ("SELECT value, first_value(value) OVER (PARTITION BY lower(trim(value)) ORDER BY n DESC, value) AS best FROM (SELECT {c} AS value, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c})")
ORACLES["x18_auto_correct"] = f"""WITH t AS ({_X18}), a AS ({_CANON.format(c='status')}), b AS ({_CANON.format(c='city')}), f AS ({fuzzy_sql('t')})
SELECT order_id, customer_ref, a.best AS status, total_amount, price_text, is_urgent, note, coalesce(f.new_value, b.best) AS city
FROM t LEFT JOIN a ON a.value = status LEFT JOIN b ON b.value = city LEFT JOIN f ON f.old_value = city"""
