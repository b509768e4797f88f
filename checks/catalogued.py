"""Checks of the knowledge-catalogue rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.cleaning import space, strip
from checks.common import AS_OF, DIRTY_ORDERS, quoted, table, union_all
from checks.rules import ALL, DIMENSIONS, SRC, TABLES, catalogue, profile, scored
from tablewright.functions import constants as C
from tablewright.operators import catalogue as K
from tablewright.operators import quality as Q
from tablewright.operators.profile import measure

QUERIES, ORACLES = {}, {}
_SPIKE = "CASE WHEN o_custkey % 50 = 0 THEN o_totalprice * 20 ELSE o_totalprice END AS price"


def spiky(s, d):
    return table(s, d, "orders").selectExpr("o_orderkey", _SPIKE)


QUERIES["k1_zscore_outliers"] = lambda s, d: K.zscore_outliers(spiky(s, d), "price", "o_orderkey")
ORACLES["k1_zscore_outliers"] = f"""SELECT o_orderkey, price AS value, round((price - m) / sd, 4) AS z FROM (SELECT o_orderkey, {_SPIKE} FROM orders), (SELECT avg(price) AS m, stddev_samp(price) AS sd FROM (SELECT {_SPIKE} FROM orders))
WHERE abs(round((price - m) / sd, 4)) > 3"""
QUERIES["k1_mad_outliers"] = lambda s, d: K.mad_outliers(spiky(s, d), "price", "o_orderkey")
ORACLES["k1_mad_outliers"] = f"""SELECT o_orderkey, price AS value, round(0.6745::DOUBLE * (price - m) / d, 4) AS score FROM (SELECT o_orderkey, {_SPIKE} FROM orders), (SELECT median(price) AS m, mad(price) AS d FROM (SELECT {_SPIKE} FROM orders))
WHERE abs(round(0.6745::DOUBLE * (price - m) / d, 4)) > 3.5"""
QUERIES["k2_rolling_median_filter"] = lambda s, d: K.rolling_median(table(s, d, "events"), "value", "ts", "event_id", ["user_id"], segments=12)
ORACLES["k2_rolling_median_filter"] = "SELECT user_id, ts, event_id, value AS v, median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smoothed FROM events"
_IMPOSSIBLE = {"quantity_over_50": "l_quantity > 45", "discount_negative": "l_discount < 0", "tax_over_5pct": "l_tax > 0.05", "free": "l_extendedprice <= 0"}
QUERIES["k3_impossible_values"] = lambda s, d: K.impossible_values(table(s, d, "lineitem"), _IMPOSSIBLE)
ORACLES["k3_impossible_values"] = union_all([f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {e}) AS violations, round(count(*) FILTER (WHERE {e}) * 100.0 / count(*), 4) AS pct FROM lineitem" for n, e in _IMPOSSIBLE.items()])
QUERIES["k4_frequency_encoding"] = lambda s, d: K.frequency_encoding(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
ORACLES["k4_frequency_encoding"] = "SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS o_custkey_frequency FROM orders"
_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
QUERIES["k4_ordinal_encoding"] = lambda s, d: K.ordinal_encoding(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", _ORDER)
ORACLES["k4_ordinal_encoding"] = "SELECT o_orderkey, o_orderpriority, CAST(nullif(list_position([" + ", ".join(quoted(o) for o in _ORDER) + "], o_orderpriority), 0) AS INTEGER) AS o_orderpriority_rank FROM orders"
QUERIES["k4_target_encoding"] = lambda s, d: K.target_encoding(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice").withColumn("o_custkey_target", F.round("o_custkey_target", 6))
ORACLES["k4_target_encoding"] = "SELECT o_orderkey, o_custkey, o_totalprice, round((sum(o_totalprice) OVER w + 20 * m) / (count(*) OVER w + 20), 6) AS o_custkey_target FROM orders, (SELECT avg(o_totalprice) AS m FROM orders) WINDOW w AS (PARTITION BY o_custkey)"
QUERIES["k5_minmax_scale"] = lambda s, d: K.minmax_scale(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).withColumn("o_totalprice_scaled", F.round("o_totalprice_scaled", 6))
ORACLES["k5_minmax_scale"] = "SELECT o_orderkey, o_totalprice, round((o_totalprice - a) / (b - a), 6) AS o_totalprice_scaled FROM orders, (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)"
QUERIES["k5_log1p_scale"] = lambda s, d: K.log1p_scale(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).withColumn("o_totalprice_log", F.round("o_totalprice_log", 6))
ORACLES["k5_log1p_scale"] = "SELECT o_orderkey, o_totalprice, round(ln(1 + o_totalprice), 6) AS o_totalprice_log FROM orders"


def durations(s, d):
    joined = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(
        table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return K.duration_features(joined, "o_orderdate", "l_shipdate").select("l_orderkey", "l_linenumber", "duration_days", "duration_hours")


QUERIES["k6_duration_features"] = durations
ORACLES["k6_duration_features"] = """SELECT l_orderkey, l_linenumber, CAST(floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000) AS BIGINT) AS duration_days,
CAST(floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000) AS BIGINT) AS duration_hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
QUERIES["k6_text_length"] = lambda s, d: K.text_length(table(s, d, "documents").select("doc_id", "text"), "text").drop("text")
ORACLES["k6_text_length"] = f"SELECT doc_id, length(text) AS text_length, CAST(len(list_filter(string_split_regex(text, {quoted(C.SPACE + '+')}), lambda w: w <> '')) AS BIGINT) AS word_count FROM documents"
QUERIES["k6_group_stats"] = lambda s, d: K.group_stats(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice").withColumn(
    "group_mean", F.round("group_mean", 6)).withColumn("group_std", F.round("group_std", 6))
ORACLES["k6_group_stats"] = "SELECT o_orderkey, o_custkey, o_totalprice, round(avg(o_totalprice) OVER w, 6) AS group_mean, count(*) OVER w AS group_count, round(stddev_samp(o_totalprice) OVER w, 6) AS group_std FROM orders WINDOW w AS (PARTITION BY o_custkey)"
_SUSPECT = {"order_id": "o_orderkey", "serial": "o_orderkey * 2 + o_custkey % 3", "country": "'India'", "currency": "CASE WHEN o_orderkey % 100 = 0 THEN 'USD' ELSE 'INR' END",
            "remark": "concat('remark ', cast(o_orderkey AS STRING))", "tags": "CASE WHEN o_orderkey % 3 = 0 THEN 'a,b' ELSE 'c' END", "amount": "o_totalprice"}


def suspects(s, d):
    t = table(s, d, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _SUSPECT.items()])
    return K.suspicious_columns(t, measure(t), "order_id")


QUERIES["k7_suspicious_columns"] = suspects
_SUS = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _SUSPECT.items()) + " FROM orders)"
ORACLES["k7_suspicious_columns"] = f"""SELECT 'country' AS column_name, 'constant' AS issue FROM {_SUS} HAVING count(DISTINCT country) = 1
UNION ALL SELECT 'currency', 'near_constant' FROM (SELECT max(n) AS top, sum(n) AS total FROM (SELECT count(*) AS n FROM {_SUS} GROUP BY currency)) WHERE top > 0.98 * total
UNION ALL SELECT 'remark', 'all_unique' FROM {_SUS} HAVING count(DISTINCT remark) = count(*)
UNION ALL SELECT 'tags', 'delimiter_packed' FROM {_SUS} HAVING count(*) FILTER (WHERE regexp_matches(tags, '[,|;]')) > 0.2 * count(tags)
UNION ALL SELECT 'serial', 'index_correlated' FROM {_SUS} HAVING abs(corr(order_id, serial)) > 0.95"""
QUERIES["k8_class_imbalance"] = lambda s, d: K.class_imbalance(table(s, d, "labels"), "quality").unionByName(K.class_imbalance(table(s, d, "labels"), "toxic"))
ORACLES["k8_class_imbalance"] = union_all([f"""SELECT '{c}' AS column_name, count(*) AS classes, min(n) AS minority, round(100.0 * min(n) / sum(n), 2) AS minority_pct,
CASE WHEN 100.0 * min(n) / sum(n) < 5 THEN 'critical' WHEN 100.0 * min(n) / sum(n) < 15 THEN 'warning' WHEN 100.0 * min(n) / sum(n) < 20 THEN 'low' ELSE 'none' END AS severity
FROM (SELECT count(*) AS n FROM labels WHERE {c} IS NOT NULL GROUP BY {c})""" for c in ("quality", "toxic")])
_LEAK = "l_quantity, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount / 100) AS net, l_extendedprice * -2 + l_linenumber AS mirrored"
QUERIES["k9_target_leakage"] = lambda s, d: K.target_leakage(table(s, d, "lineitem").selectExpr(*_LEAK.split(", ")), "l_extendedprice")
ORACLES["k9_target_leakage"] = "SELECT * FROM (" + union_all([f"SELECT '{c}' AS column_name, round(corr({c}, l_extendedprice), 3) AS correlation FROM (SELECT {_LEAK} FROM lineitem) HAVING abs(corr({c}, l_extendedprice)) > 0.95" for c in ("l_quantity", "l_discount", "net", "mirrored")]) + ")"
QUERIES["k10_key_conflicts"] = lambda s, d: K.key_conflicts(table(s, d, "part"), "p_name", ["p_brand", "p_type"])
ORACLES["k10_key_conflicts"] = "SELECT p_name AS key, count(DISTINCT (p_brand, p_type)) AS variants FROM part GROUP BY 1 HAVING variants > 1"
QUERIES["k11_broken_measure"] = lambda s, d: K.broken_measure(table(s, d, "customer"), "c_acctbal")
ORACLES["k11_broken_measure"] = """SELECT count(*) FILTER (WHERE c_acctbal = 0) AS zeros, count(*) FILTER (WHERE c_acctbal < 0) AS negatives, count(*) - count(c_acctbal) AS nulls, count(*) AS "rows" FROM customer"""
QUERIES["k12_date_gaps"] = lambda s, d: K.date_gaps(table(s, d, "orders").select(F.date_trunc("week", "o_orderdate").alias("week")), "week")
ORACLES["k12_date_gaps"] = """SELECT p AS from_day, w AS to_day, CAST(w - p AS BIGINT) AS days FROM (SELECT w, lag(w) OVER (ORDER BY w) AS p FROM (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS w FROM orders)) WHERE w - p >= 2"""
QUERIES["k13_sensitive_names"] = lambda s, d: K.sensitive_names(catalogue(s, d).withColumn("column_name", F.replace("column_name", F.lit("acctbal"), F.lit("Salary"))))
ORACLES["k13_sensitive_names"] = f"""SELECT DISTINCT table_name, replace(column_name, 'acctbal', 'Salary') AS column_name, 'salary' AS pattern FROM information_schema.columns
WHERE table_name IN ({', '.join(quoted(t) for t in TABLES)}) AND contains(column_name, 'acctbal')"""
_MIXED = "o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN concat('$', cast(o_custkey AS STRING)) ELSE concat('₹', cast(o_custkey AS STRING)) END AS price, concat('$', cast(o_custkey AS STRING)) AS cost, CASE o_custkey % 3 WHEN 0 THEN '2024-01-01T10:00:00Z' WHEN 1 THEN '2024-01-01T10:00:00+05:30' ELSE '2024-01-01T10:00:00' END AS seen"


def mixed(s, d):
    table(s, d, "orders").createOrReplaceTempView("orders_mixed")
    return s.sql(f"SELECT {_MIXED} FROM orders_mixed")


QUERIES["k13_currency_mixing"] = lambda s, d: K.currency_mixing(mixed(s, d))
ORACLES["k13_currency_mixing"] = f"""SELECT 'price' AS column_name, count(DISTINCT left(price, 1)) AS kinds, count(*) AS "values" FROM (SELECT {_MIXED} FROM orders)"""
QUERIES["k13_timezone_mixing"] = lambda s, d: K.timezone_mixing(mixed(s, d))
ORACLES["k13_timezone_mixing"] = f"""SELECT 'seen' AS column_name, count(DISTINCT substr(seen, 20)) AS kinds, count(*) AS "values" FROM (SELECT {_MIXED} FROM orders) WHERE length(seen) > 19"""
QUERIES["k14_distribution_drift"] = lambda s, d: K.distribution_drift(table(s, d, "events"), "value", F.col("ts") >= F.lit("2024-01-16").cast("timestamp"), segments=8)
ORACLES["k14_distribution_drift"] = """WITH t AS (SELECT value AS v, CAST(ts >= TIMESTAMP '2024-01-16' AS INTEGER) AS b FROM events), n AS (SELECT count(*) FILTER (WHERE b = 0) AS n0, count(*) FILTER (WHERE b = 1) AS n1, avg(v) FILTER (WHERE b = 0) AS m0, avg(v) FILTER (WHERE b = 1) AS m1 FROM t),
k AS (SELECT max(abs(c0 / n0 - c1 / n1)) AS ks FROM (SELECT v, sum(1 - b) OVER (ORDER BY v) AS c0, sum(b) OVER (ORDER BY v) AS c1 FROM t), n)
SELECT 'value' AS column_name, round(ks, 6) AS ks_distance, round(m0, 4) AS mean_before, round(m1, 4) AS mean_after, ks > 1.358 * sqrt((n0 + n1) / (n0 * n1)) AS drifted FROM k, n"""
QUERIES["k15_schema_drift"] = lambda s, d: K.schema_drift(table(s, d, "orders"), table(s, d, "orders").drop("o_orderstatus").withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("channel", F.lit("web")))
ORACLES["k15_schema_drift"] = """WITH c AS (SELECT DISTINCT column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' END AS type FROM information_schema.columns WHERE table_name = 'orders')
SELECT column_name, type AS expected_type, CASE column_name WHEN 'o_custkey' THEN 'string' END AS actual_type, CASE column_name WHEN 'o_custkey' THEN 'retyped' ELSE 'missing' END AS change FROM c WHERE column_name IN ('o_orderstatus', 'o_custkey')
UNION ALL SELECT 'channel', NULL, 'string', 'new'"""
QUERIES["k16_pii_masking"] = lambda s, d: K.mask_pii(table(s, d, "documents"), "doc_id", "text")
_MASK = "regexp_replace(text, '[a-zA-Z0-9._%+-]+@([a-zA-Z0-9.-]+\\.[a-zA-Z]{2,})', '[email]@\\1', 'g')"
for _p, _r in ((C.PII_PATTERNS["ssn"], "[id]"), (K.CARD, "[card]")):
    _MASK = f"regexp_replace({_MASK}, {quoted(_p)}, '{_r}', 'g')"
_MASK = f"regexp_replace({_MASK}, '\\+?\\d{{1,3}}[-.\\s]?\\(?\\d{{3}}\\)?[-.\\s]?\\d{{3}}[-.\\s]?(\\d{{4}})', '[phone]\\1', 'g')"
ORACLES["k16_pii_masking"] = f"SELECT doc_id, {_MASK} AS text, sha256(text) AS fingerprint FROM documents"
QUERIES["k16_card_numbers"] = lambda s, d: K.card_numbers(table(s, d, "documents"), "doc_id", "text")
ORACLES["k16_card_numbers"] = f"""SELECT doc_id, digits, list_sum(list_transform(range(0, length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(digits[length(digits) - i] AS INTEGER)
WHEN CAST(digits[length(digits) - i] AS INTEGER) > 4 THEN CAST(digits[length(digits) - i] AS INTEGER) * 2 - 9 ELSE CAST(digits[length(digits) - i] AS INTEGER) * 2 END)) % 10 = 0 AS valid
FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, {quoted(K.CARD)})), '[^0-9]', '', 'g') AS digits FROM documents)"""
QUERIES["k17_referential_integrity"] = lambda s, d: K.orphans(table(s, d, "orders"), "o_custkey", table(s, d, "customer").filter("c_acctbal >= 0"), "c_custkey")
ORACLES["k17_referential_integrity"] = """SELECT o_custkey AS key, count(*) AS "rows" FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY 1"""
_RULES = {"quantity_positive": "l_quantity > 0", "discount_under_tax": "l_discount <= l_tax", "returned_is_final": "CASE WHEN l_returnflag = 'R' THEN l_linestatus = 'F' END"}
QUERIES["k18_cross_field_rules"] = lambda s, d: K.rule_pass_rates(table(s, d, "lineitem"), _RULES)
ORACLES["k18_cross_field_rules"] = union_all([f"SELECT '{n}' AS rule, round(avg(CAST(({e}) AS INTEGER)) * 100, 2) AS pass_pct FROM lineitem" for n, e in _RULES.items()])
QUERIES["k19_spearman"] = lambda s, d: K.spearman(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", segments=6)
ORACLES["k19_spearman"] = """SELECT 'l_quantity' AS col1, 'l_extendedprice' AS col2, round(corr(a, b), 4) AS spearman FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a,
rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)"""
QUERIES["k20_near_duplicates"] = lambda s, d: K.near_duplicates(table(s, d, "documents"), "doc_id", "text")
ORACLES["k20_near_duplicates"] = f"""SELECT md5(lower({space('text')})) AS form, count(*) AS copies, count(DISTINCT text) AS spellings, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"""
# A long text per part and three copies of it with one, two and three characters replaced.
_LONG = "concat(md5(cast(p_partkey AS STRING)), ' ', md5(concat('x', cast(p_partkey AS STRING))), ' ', md5(concat('y', cast(p_partkey AS STRING))))"
_TYPOS = {0: _LONG, 1: f"concat('z', substr({_LONG}, 2))", 2: f"concat('z', substr({_LONG}, 2, 49), 'z', substr({_LONG}, 52))", 3: f"concat('z', substr({_LONG}, 2, 49), 'z', substr({_LONG}, 52, 46), 'z')"}


def typo_copies(s, d):
    parts = table(s, d, "part")
    copies = [parts.selectExpr(f"p_partkey * 4 + {k} AS id", f"{e} AS text") for k, e in _TYPOS.items()]
    return K.typo_copies(copies[0].union(copies[1]).union(copies[2]).union(copies[3]), "id", "text")


QUERIES["k20_typo_copies"] = typo_copies
ORACLES["k20_typo_copies"] = union_all([f"SELECT p_partkey * 4 + {a} AS first_id, p_partkey * 4 + {b} AS copy_id, CAST({b - a} AS INTEGER) AS edits FROM part" for a in range(4) for b in range(a + 1, 4)])
_GATES = {"volume": ("count(*)", 100, None), "freshness_days": (f"datediff(DATE '{AS_OF}', max(o_orderdate))", None, 30), "null_rate": ("avg(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END)", None, 0.01),
          "mean_price": ("avg(o_totalprice)", 1000, 1000000)}
QUERIES["k21_quality_gates"] = lambda s, d: K.quality_gates(table(s, d, "orders"), _GATES)
ORACLES["k21_quality_gates"] = f"""WITH m AS (SELECT CAST(count(*) AS DOUBLE) AS a, CAST(DATE '{AS_OF}' - CAST(max(o_orderdate) AS DATE) AS DOUBLE) AS b, avg(CASE WHEN o_custkey IS NULL THEN 1.0 ELSE 0 END) AS c, avg(o_totalprice) AS d FROM orders)
SELECT 'volume' AS gate, round(a, 4) AS value, a >= 100 AS passed FROM m UNION ALL SELECT 'freshness_days', round(b, 4), b <= 30 FROM m UNION ALL SELECT 'null_rate', round(c, 4), c <= 0.01 FROM m UNION ALL SELECT 'mean_price', round(d, 4), d BETWEEN 1000 AND 1000000 FROM m"""
QUERIES["k22_rfm"] = lambda s, d: K.rfm(table(s, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", AS_OF)
ORACLES["k22_rfm"] = f"""WITH p AS (SELECT o_custkey AS customer, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(max(o_orderdate))) / 86400) AS BIGINT) AS recency, count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary FROM orders GROUP BY 1),
q AS (SELECT {', '.join(f"quantile_cont(CAST({c} AS DOUBLE), 0.{2 * i}) AS {c[0]}{i}" for c in ('recency', 'frequency', 'monetary') for i in range(1, 5))} FROM p)
SELECT customer, recency, frequency, monetary, CAST(5 - ({' + '.join(f'CAST(recency > r{i} AS INTEGER)' for i in range(1, 5))}) AS INTEGER) AS r_score,
CAST(1 + {' + '.join(f'CAST(frequency > f{i} AS INTEGER)' for i in range(1, 5))} AS INTEGER) AS f_score, CAST(1 + {' + '.join(f'CAST(monetary > m{i} AS INTEGER)' for i in range(1, 5))} AS INTEGER) AS m_score FROM p, q"""
QUERIES["k22_customer_value"] = lambda s, d: K.customer_value(table(s, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice")
ORACLES["k22_customer_value"] = """SELECT customer, round(a, 6) AS average_order, round(n / y, 4) AS orders_per_year, round(y, 4) AS years, round(a * n, 2) AS value FROM (SELECT o_custkey AS customer, avg(o_totalprice) AS a, count(*) AS n,
greatest((epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400 / 365, 1.0) AS y FROM orders GROUP BY 1)"""


def baskets(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(
        table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")


QUERIES["k22_basket_pairs"] = lambda s, d: K.basket_pairs(baskets(s, d), "l_orderkey", "p_brand", 0.005)
ORACLES["k22_basket_pairs"] = """WITH h AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey), b AS (SELECT count(DISTINCT basket) AS n FROM h),
c AS (SELECT item, count(*) AS k FROM h GROUP BY 1), p AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS together FROM h x JOIN h y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2)
SELECT item_a, item_b, together, round(together / n, 6) AS support, round(together / ca.k, 4) AS confidence, round(together * CAST(n AS DOUBLE) / (ca.k * cb.k), 4) AS lift
FROM p JOIN c ca ON ca.item = item_a JOIN c cb ON cb.item = item_b, b WHERE together >= 0.005 * n"""
QUERIES["k23_sector_benchmark_grade"] = lambda s, d: Q.sector_benchmark_grade(profile(s, d), AS_OF, "retail")
ORACLES["k23_sector_benchmark_grade"] = DIMENSIONS + """, v AS (SELECT 'completeness' AS measure, (SELECT 1 - sum(missing) / sum(n) FROM ms) AS value, 0.97 AS e, 0.93 AS g, 0.90 AS a, 0.85 AS p, 1 AS dir
UNION ALL SELECT 'uniqueness', (SELECT 1 - k / n FROM dup), 0.99, 0.98, 0.97, 0.95, 1 UNION ALL SELECT 'consistency', (SELECT consistency / 100 FROM s), 0.97, 0.94, 0.91, 0.85, 1
UNION ALL SELECT 'timeliness_days', (SELECT days FROM age), 1, 7, 14, 30, -1)
SELECT measure, round(CAST(value AS DOUBLE), 4) AS value, CASE WHEN value * dir >= e * dir THEN 'excellent' WHEN value * dir >= g * dir THEN 'good' WHEN value * dir >= a * dir THEN 'acceptable' WHEN value * dir >= p * dir THEN 'poor' ELSE 'failing' END AS grade FROM v"""
