"""Quality, threat, recommendation and insight checks."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from checks.common import AS_OF, DIRTY_ORDERS, LINEITEM_NUMBERS, dirty_orders, dirty_orders_sql, quoted, table, union_all
from checks.profiling import (CARDINALITY, CORR_COLUMNS, CORR_SOURCE, LOOKS_NUMERIC, STRIPPED, correlated, fences, over,
                              pair_sql, ranked_values)
from tablewright.functions import constants as C
from tablewright.operators import insights as N
from tablewright.operators import quality as Q
from tablewright.operators import recommend as R
from tablewright.operators import threats as T
from tablewright.operators.profile import measure

QUERIES, ORACLES = {}, {}

# The scored table: dirty orders, lines as numbers, and a date column.
KINDS = {"order_id": "numeric", "customer_ref": "text", "status": "text", "total_amount": "numeric", "price_text": "text",
         "is_urgent": "text", "note": "text", "city": "text", "email": "text", "contact_phone": "text", "mixed_number": "text"}
EXTRA = {"order_date": "datetime", "amount_squared": "numeric", "amount_taxed": "numeric", "constant_flag": "text"}
EXTRA_SQL = {"order_date": "o_orderdate", "amount_squared": "o_totalprice * o_totalprice / 1e6",
             "amount_taxed": "o_totalprice * 1.1 + o_custkey % 7", "constant_flag": "'x'"}
ALL = {**KINDS, **EXTRA}
_SELECT = ", ".join([f"{DIRTY_ORDERS[c]} AS {c}" for c in KINDS] + [f"{EXTRA_SQL[c]} AS {c}" for c in EXTRA])
SRC = f"(SELECT {_SELECT} FROM orders)"
TEXT = [c for c, k in ALL.items() if k == "text"]
NUM = [c for c, k in ALL.items() if k == "numeric"]


def scored(s, d):
    return table(s, d, "orders").selectExpr(*[f"{DIRTY_ORDERS[c]} AS {c}" for c in KINDS], *[f"{EXTRA_SQL[c]} AS {c}" for c in EXTRA])


_MEASURED = {}


def profile(s, d):
    """Measured once per session and folder: rules are queries over the metrics, not new scans."""
    key = (s.sparkContext.applicationId, d)
    if key not in _MEASURED:
        _MEASURED[key] = measure(scored(s, d))
    return _MEASURED[key]


_NAMED = "({})".format
ID_LIKE = _NAMED(" OR ".join(f"contains(lower(column_name), '{w}')" for w in C.IDENTIFIER_NAMES))


@dataclass
class Stated:
    """SQL that states the measures, dimensions and threats of one table."""

    text_metrics: str
    num_metrics: str
    missing: str
    far: str
    out: str
    dimensions: str
    threats: dict[str, str]


def stated(kinds: dict[str, str], src: str, dated: str | None = None) -> Stated:
    """For a table given as SQL, the kinds of its columns, and its date column if it has one."""
    text, num = [c for c, k in kinds.items() if k == "text"], [c for c, k in kinds.items() if k == "numeric"]
    age = f"(SELECT floor((epoch(TIMESTAMP '{AS_OF}') - epoch(max({dated}))) / 86400.0) FROM {src})" if dated else "NULL"
    text_metrics = over(text, "count(*) AS n, count({c}) AS present, count(DISTINCT {c}) AS d, count(DISTINCT lower({c})) AS dl, "
                              "count(DISTINCT lower(" + STRIPPED + ")) AS dn, count(*) FILTER (WHERE " + LOOKS_NUMERIC + ") AS looks, "
                              "count(*) FILTER (WHERE regexp_matches({c}, " + quoted(C.REFERENCE_MARK) + ")) AS refs, "
                              "count(*) FILTER (WHERE regexp_matches({c}, " + quoted(C.CURRENCY) + ")) AS cur, "
                              "count(*) FILTER (WHERE {c} <> " + STRIPPED + ") AS ws, "
                              + ", ".join("count(*) FILTER (WHERE regexp_matches({c}, " + quoted(p) + f")) AS {k}"
                                          for k, p in C.PII_PATTERNS.items()), src)
    num_metrics = over(num, "count(*) AS n, count({c}) AS present, count(DISTINCT {c}) AS d, stddev_samp({c}) AS sd, skewness({c}) AS sk, "
                            "quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3", src)
    missing = over(list(kinds), "count(*) AS n, count(*) - count({c}) AS missing", src)
    far = fences(num, src, "3")
    out = fences(num, src, "1.5")
    dimensions = f"""
WITH tx AS ({text_metrics}), nm AS ({num_metrics}), ms AS ({missing}), far AS ({far}),
dup AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS k, count(*) AS n FROM {src}),
age AS (SELECT {age} AS days),
s AS (SELECT
 greatest(0, 100 - (SELECT sum(missing) / sum(n) * 250 FROM ms)) AS completeness,
 greatest(0, 100 - (SELECT k / n * 500 FROM dup)) AS uniqueness,
 greatest(0, 100 - (SELECT sum(CASE WHEN d > dn THEN (d - dn) / d * 30 ELSE 0 END + ws / present * 15) FROM tx WHERE present > 0)) AS consistency,
 greatest(0, 100 - (SELECT sum(CASE WHEN looks / present > 0.5 THEN looks / present * 25 ELSE 0 END
   + CASE WHEN refs / present > 0.1 THEN refs / present * 20 ELSE 0 END
   + CASE WHEN cur / present > 0.3 THEN cur / present * 15 ELSE 0 END) FROM tx WHERE present > 0)) AS type_correctness,
 greatest(0, 100 - (SELECT sum(far.outliers / far.n * 100) FROM far JOIN nm USING (column_name) WHERE nm.q3 > nm.q1 AND far.n > 10)) AS validity,
 greatest(0, 100 - (SELECT coalesce(sum(CASE WHEN sd < 0.001 THEN 10 ELSE 0 END), 0) FROM nm)
   - (SELECT coalesce(sum(CASE WHEN d = 1 AND present > 5 THEN 5 ELSE 0 END), 0) FROM tx)) AS accuracy,
 (SELECT CASE WHEN days > 730 THEN greatest(50, 90 - least(days / 365, 5) * 8) ELSE 90 END FROM age) AS timeliness),
dims AS (""" + union_all([f"SELECT {i} AS position, '{n}' AS dimension, CAST({n} AS DOUBLE) AS score, CAST({w} AS DOUBLE) AS weight FROM s"
                              for i, (n, w) in enumerate(C.QUALITY_WEIGHTS.items())]) + ")"
    threats = {
        "t1_missing": f"""SELECT concat('mv_', column_name) AS id, CASE WHEN {ID_LIKE} OR pct > 30 THEN 'critical' WHEN pct > 5 THEN 'warning' ELSE 'low' END AS severity,
 concat('Missing values in ', column_name, ' (', pct, '%)') AS title, column_name, 'Data Quality' AS category,
 CAST(CASE WHEN {ID_LIKE} THEN 99 WHEN pct > 30 THEN 90 WHEN pct > 5 THEN 85 ELSE 88 END AS INTEGER) AS confidence
 FROM (SELECT column_name, round(missing * 100.0 / n, 2) AS pct FROM ({missing})) WHERE pct > 0""",
        "t2_duplicates": f"""SELECT 'dup_exact' AS id, CASE WHEN pct > 5 THEN 'critical' WHEN pct > 1 THEN 'warning' ELSE 'low' END AS severity,
 concat('Duplicate rows (', k, ', ', pct, '%)') AS title, 'All columns' AS column_name, 'Data Quality' AS category, CAST(95 AS INTEGER) AS confidence
 FROM (SELECT k, round(k * 100.0 / n, 2) AS pct FROM (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS k FROM {src})) WHERE k > 0""",
        "t3_inconsistent_categories": f"""SELECT concat('inc_', column_name) AS id, CASE WHEN d - dl > 3 THEN 'warning' ELSE 'low' END AS severity,
 concat('Inconsistent categories in ', column_name) AS title, column_name, 'Data Quality' AS category, CAST(94 AS INTEGER) AS confidence
 FROM ({text_metrics}) WHERE d > dl AND d <= 100""",
        "t4_mixed_types": f"""SELECT concat('mt_', column_name) AS id, 'critical' AS severity, concat('Mixed data types in ', column_name) AS title, column_name,
 'Data Quality' AS category, CAST(91 AS INTEGER) AS confidence FROM ({text_metrics}) WHERE present > 0 AND looks * 100.0 / present > 20 AND looks * 100.0 / present < 95""",
        "t5_outliers": f"""SELECT concat('out_', column_name) AS id, CASE WHEN pct > 1 THEN 'warning' ELSE 'low' END AS severity,
 concat('Outliers in ', column_name, ' (', outliers, ' values, ', pct, '%)') AS title, column_name, 'Data Quality' AS category, CAST(88 AS INTEGER) AS confidence
 FROM (SELECT column_name, outliers, round(outliers * 100.0 / n, 2) AS pct FROM ({out})) WHERE outliers > 0""",
        "t7_collinearity": f"""SELECT concat('corr_', col1, '_', col2) AS id, CASE WHEN abs(r) > 0.95 THEN 'critical' ELSE 'warning' END AS severity,
 concat('Correlated features (r=', r, ')') AS title, concat(col1, ' ↔ ', col2) AS column_name, 'ML Risk' AS category,
 CAST(CASE WHEN abs(r) > 0.95 THEN 97 ELSE 85 END AS INTEGER) AS confidence FROM (SELECT col1, col2, round(r, 3) AS r FROM ({pair_sql(num, src)})) WHERE NOT isnan(r) AND abs(r) > 0.85""",
        "t8_pii_columns": union_all([
            f"""SELECT concat('pii_{k}_', column_name) AS id, 'critical' AS severity, concat('{C.PII_LABELS[k]} in ', column_name) AS title, column_name,
 'Privacy' AS category, CAST(96 AS INTEGER) AS confidence FROM ({text_metrics}) WHERE present > 0 AND {k} * 100.0 / present > 30""" for k in C.PII_PATTERNS]),
        "t9_stale_data": f"""SELECT 'stale_order_date' AS id, 'warning' AS severity, concat('Stale data (', age, ' days old)') AS title, 'order_date' AS column_name,
 'Business' AS category, CAST(82 AS INTEGER) AS confidence FROM (SELECT CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(max(order_date))) / 86400.0) AS BIGINT) AS age,
 floor((epoch(max(order_date)) - epoch(min(order_date))) / 86400.0) AS span FROM {src}) WHERE age > 90 AND span > 90""",
    }
    if not dated:
        del threats["t9_stale_data"]
    return Stated(text_metrics, num_metrics, missing, far, out, dimensions, threats)


OWN = stated(ALL, SRC, "order_date")
TEXT_METRICS, NUM_METRICS, MISSING, FAR, OUT, DIMENSIONS, THREAT_PARTS = (
    OWN.text_metrics, OWN.num_metrics, OWN.missing, OWN.far, OWN.out, OWN.dimensions, OWN.threats)


def facts_sql(kinds: dict[str, str], src: str, dated: str | None = None) -> str:
    """(section, item, value) of a table: everything a comparison of two profiles looks at."""
    own = stated(kinds, src, dated)
    threats = union_all([f"SELECT id, severity FROM ({q})" for q in own.threats.values()])
    cells = f"SELECT sum(missing) AS missing, any_value(n) AS n FROM ({own.missing})"
    copies = f"(SELECT count(*) FROM {src}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src}))"
    return f"""SELECT 'shape' AS section, 'rows' AS item, CAST((SELECT count(*) FROM {src}) AS DOUBLE) AS value
UNION ALL SELECT 'shape', 'cols', {len(kinds)} UNION ALL SELECT 'missing', 'cells', missing FROM ({cells})
UNION ALL SELECT 'missing', 'pct', round(missing * 100.0 / (n * {len(kinds)}), 2) FROM ({cells}) UNION ALL SELECT 'duplicates', 'rows', {copies}
UNION ALL SELECT 'column_missing_pct', column_name, round(missing * 100.0 / n, 2) FROM ({own.missing})
UNION ALL SELECT 'quality_score', 'overall', o FROM ({own.dimensions} SELECT round(sum(score * weight), 1) AS o FROM dims)
UNION ALL SELECT 'dimension', dimension, score FROM ({own.dimensions} SELECT dimension, round(score, 1) AS score FROM dims)
UNION ALL SELECT 'threats', 'total', count(*) FROM ({threats}) UNION ALL SELECT 'threats', 'critical', count(*) FILTER (WHERE severity = 'critical') FROM ({threats})"""


def comparison_sql(kinds: dict[str, str], src: str, new_kinds: dict[str, str], new: str, dated: str | None = None) -> str:
    """The facts of a table and of what became of it side by side; both tables are worked out once."""
    return f"""WITH old_table AS MATERIALIZED (SELECT * FROM {src}), new_table AS MATERIALIZED (SELECT * FROM {new}),
b AS ({facts_sql(kinds, "(SELECT * FROM old_table)", dated)}), a AS ({facts_sql(new_kinds, "(SELECT * FROM new_table)", dated)})
SELECT section, item, before, after, round(after - before, 2) + 0 AS change,
CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'dropped' WHEN round(after - before, 2) = 0 THEN 'same' ELSE 'changed' END AS status
FROM (SELECT coalesce(b.section, a.section) AS section, coalesce(b.item, a.item) AS item, b.value AS before, a.value AS after
FROM b FULL OUTER JOIN a ON a.section = b.section AND a.item = b.item)"""


GRADE = ("CASE WHEN {x} >= 95 THEN 'A+' WHEN {x} >= 90 THEN 'A' WHEN {x} >= 80 THEN 'B' WHEN {x} >= 60 THEN 'C' WHEN {x} >= 40 THEN 'D' ELSE 'F' END")

for dim, key in zip(C.QUALITY_WEIGHTS, ["q1", "q2", "q3", "q4", "q5", "q6", "q7"]):
    QUERIES[f"{key}_{dim}"] = lambda s, d, dim=dim: Q.dimensions(profile(s, d), AS_OF).filter(f"dimension = '{dim}'")
    ORACLES[f"{key}_{dim}"] = DIMENSIONS + f"SELECT dimension, round(score, 1) AS score, weight FROM dims WHERE dimension = '{dim}'"
QUERIES["q8_quality_score"] = lambda s, d: Q.quality_score(profile(s, d), AS_OF)
ORACLES["q8_quality_score"] = DIMENSIONS + f"SELECT round(o, 1) AS overall, {GRADE.format(x='o')} AS grade FROM (SELECT sum(score * weight) AS o FROM dims)"
QUERIES["q4_type_issues"] = lambda s, d: Q.type_issues(profile(s, d))
ORACLES["q4_type_issues"] = f"WITH tx AS ({TEXT_METRICS})" + union_all([
    f"SELECT column_name, '{i}' AS issue, round({k} / present, 2) AS ratio FROM tx WHERE present > 0 AND {k} / present > {t}"
    for i, k, t in (("numeric_as_string", "looks", 0.5), ("embedded_references", "refs", 0.1), ("unparsed_currency", "cur", 0.3))])
QUERIES["q9_benchmark_compare"] = lambda s, d: Q.benchmark_compare(profile(s, d), AS_OF)
ORACLES["q9_benchmark_compare"] = DIMENSIONS + """, v AS (
SELECT 'Missing Value Rate' AS metric, round((SELECT sum(missing) * 100.0 / sum(n) FROM ms), 2) AS yours, 3.0 AS industry, false AS high
UNION ALL SELECT 'Duplicate Rate', round((SELECT k * 100.0 / n FROM dup), 2), 1.0, false
UNION ALL SELECT 'Completeness Score', round((SELECT completeness FROM s), 1), 85.0, true
UNION ALL SELECT 'Overall Health', round((SELECT sum(score * weight) FROM dims), 1), 80.0, true)
SELECT metric, yours, CAST(industry AS DOUBLE) AS industry, CASE WHEN (high AND yours >= industry) OR (NOT high AND yours <= industry) THEN 'success' ELSE 'warning' END AS status,
CAST(CASE WHEN high AND yours < industry THEN round(industry - yours) ELSE 0 END AS DOUBLE) AS points_below FROM v"""

# Threats -------------------------------------------------------------------------------------
BRIEF = ["id", "severity", "title", "column_name", "category", "confidence"]
_BUILD = {
    "t1_missing": lambda p: T.missing_threats(p), "t2_duplicates": lambda p: T.duplicate_threats(p),
    "t3_inconsistent_categories": lambda p: T.inconsistent_category_threats(p), "t4_mixed_types": lambda p: T.mixed_type_threats(p),
    "t5_outliers": lambda p: T.outlier_threats(p), "t7_collinearity": lambda p: T.collinearity_threats(p),
    "t8_pii_columns": lambda p: T.pii_threats(p), "t9_stale_data": lambda p: T.stale_threats(p, AS_OF),
}
for key, build in _BUILD.items():
    QUERIES[key] = lambda s, d, build=build: build(profile(s, d)).select(*BRIEF)
    ORACLES[key] = THREAT_PARTS[key]
_FLAGS = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"]
QUERIES["t2_duplicate_lines"] = lambda s, d: T.duplicate_threats(measure(table(s, d, "lineitem").select(*_FLAGS))).select(*BRIEF)
ORACLES["t2_duplicate_lines"] = THREAT_PARTS["t2_duplicates"].replace(SRC, f"(SELECT {', '.join(_FLAGS)} FROM lineitem)")
ALL_THREATS = union_all([f"SELECT * FROM ({q})" for q in THREAT_PARTS.values()])
QUERIES["t10_rank_threats"] = lambda s, d: T.rank_threats(profile(s, d), AS_OF).select(*BRIEF)
ORACLES["t10_rank_threats"] = ALL_THREATS
QUERIES["t10_threat_counts"] = lambda s, d: T.threat_counts(profile(s, d), AS_OF)
ORACLES["t10_threat_counts"] = f"""SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical,
count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'low') AS low FROM ({ALL_THREATS})"""

# Recommendations -----------------------------------------------------------------------------
RATED = f"""(SELECT column_name, 'text' AS kind, d, n, round((n - present) * 100.0 / n, 2) AS miss, {CARDINALITY.format(d='d', n='n')} AS card,
 CAST(NULL AS DOUBLE) AS sk, CAST(NULL AS DOUBLE) AS outp, 'unknown' AS shape FROM ({TEXT_METRICS})
 UNION ALL SELECT m.column_name, 'numeric', m.d, m.n, round((m.n - m.present) * 100.0 / m.n, 2), {CARDINALITY.format(d='m.d', n='m.n')}, round(m.sk, 3),
 round(o.outliers * 100.0 / o.n, 2), CASE WHEN m.sk IS NULL THEN 'unknown' WHEN abs(m.sk) < 0.5 THEN 'approximately_normal' WHEN m.sk > 0.5 THEN 'right_skewed' ELSE 'left_skewed' END
 FROM ({NUM_METRICS}) m JOIN ({OUT}) o USING (column_name)
 UNION ALL SELECT 'order_date', 'datetime', count(DISTINCT order_date), count(*), 0.0, 'High', NULL, NULL, 'unknown' FROM {SRC})"""


def like_any(words):
    return "(" + " OR ".join(f"contains(lower(column_name), '{w}')" for w in words) + ")"


REC = {
    "r1_recommend_imputation": f"""SELECT column_name, 'missing_value' AS type, CASE WHEN miss > 50 THEN 'consider_dropping' WHEN kind = 'numeric' AND abs(coalesce(sk, 0)) > 1 THEN 'median'
 WHEN kind = 'numeric' THEN 'mean' WHEN card IN ('Low', 'Binary', 'Moderate') THEN 'mode' ELSE 'add_unknown' END AS strategy,
 CAST(CASE WHEN miss > 50 THEN 85 WHEN kind = 'numeric' AND abs(coalesce(sk, 0)) > 1 THEN 92 WHEN kind = 'numeric' THEN 88 WHEN card IN ('Low', 'Binary', 'Moderate') THEN 86 ELSE 80 END AS INTEGER) AS confidence
 FROM {RATED} WHERE miss > 0""",
    "r2_recommend_encoding": f"""SELECT column_name, 'encoding' AS type, CASE WHEN card = 'Binary' THEN 'label_encoding' WHEN d <= 10 THEN 'one_hot' WHEN d <= 30 THEN 'target_encoding' ELSE 'hash_encoding' END AS strategy,
 CAST(CASE WHEN card = 'Binary' THEN 95 WHEN d <= 10 THEN 90 WHEN d <= 30 THEN 82 ELSE 72 END AS INTEGER) AS confidence FROM {RATED} WHERE kind = 'text' AND card NOT IN ('ID', 'High')""",
    "r3_recommend_scaling": f"""SELECT column_name, 'scaling' AS type, CASE WHEN outp > 3 THEN 'robust_scaler' WHEN shape = 'right_skewed' THEN 'log_transform_then_standard' ELSE 'standard_scaler' END AS strategy,
 CAST(CASE WHEN outp > 3 THEN 92 WHEN shape = 'right_skewed' THEN 86 ELSE 90 END AS INTEGER) AS confidence FROM {RATED} WHERE kind = 'numeric' AND card NOT IN ('ID', 'Binary')""",
    "r4_recommend_features": f"""SELECT column_name, 'feature_engineering' AS type, CASE WHEN {like_any(C.DATE_PART_NAMES)} THEN 'date_decomposition' ELSE 'binning' END AS strategy,
 CAST(CASE WHEN {like_any(C.DATE_PART_NAMES)} THEN 88 ELSE 78 END AS INTEGER) AS confidence FROM {RATED} WHERE {like_any(C.DATE_PART_NAMES)} OR {like_any(C.SEGMENT_NAMES)}""",
}
for key, f in {"r1_recommend_imputation": R.recommend_imputation, "r2_recommend_encoding": R.recommend_encoding,
               "r3_recommend_scaling": R.recommend_scaling, "r4_recommend_features": R.recommend_features}.items():
    QUERIES[key] = lambda s, d, f=f: f(profile(s, d))
    ORACLES[key] = REC[key]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def catalogue(s, d):
    rows = [(t, f.name) for t in TABLES for f in table(s, d, t).schema.fields]
    return s.createDataFrame(rows, "table_name string, column_name string")


QUERIES["r6_detect_sector"] = lambda s, d: R.detect_sector(catalogue(s, d))
_WORDS = ", ".join(f"('{s}', {quoted(n)}, {float(w)}, {len(ws)}, {i}, '{x}')"
                   for i, (s, (n, w, ws)) in enumerate(C.SECTORS.items()) for x in ws)
ORACLES["r6_detect_sector"] = f"""
WITH w(sector, sector_name, weight, size, place, word) AS (VALUES {_WORDS}),
c AS (SELECT DISTINCT table_name, replace(lower(column_name), ' ', '_') AS plain FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)})),
m AS (SELECT table_name, sector, sector_name, place, count(DISTINCT word) AS k, count(DISTINCT word) * CAST(any_value(weight) AS DOUBLE) / any_value(size) * 100 AS score
 FROM c JOIN w ON contains(plain, word) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY score DESC, place) AS rank FROM m)
SELECT t.table_name, CASE WHEN score >= 5 THEN sector ELSE 'general' END AS sector_id, CASE WHEN score >= 5 THEN sector_name ELSE 'General Business' END AS sector_name,
CAST(CASE WHEN score >= 5 THEN least(round(score, 1), 99) ELSE 50 END AS DOUBLE) AS confidence, CAST(CASE WHEN score >= 5 THEN k ELSE 0 END AS BIGINT) AS matched_patterns
FROM (SELECT DISTINCT table_name FROM c) t LEFT JOIN (SELECT * FROM b WHERE rank = 1) USING (table_name)"""

# Insights ------------------------------------------------------------------------------------
MONEY = ("CASE WHEN abs({x}) >= 1e7 THEN printf('₹%.2fCr', {x} / 1e7) WHEN abs({x}) >= 1e5 THEN printf('₹%.2fL', {x} / 1e5) "
         "WHEN abs({x}) >= 1e3 THEN printf('₹%.1fK', {x} / 1e3) ELSE printf('₹%.2f', {x}) END")
QUERIES["n1_kpis"] = lambda s, d: N.kpis(scored(s, d))
ORACLES["n1_kpis"] = f"""SELECT column_name, round(total, 2) AS total, round(mean, 2) AS mean, round(med, 2) AS median, round(sd, 2) AS std, round(lo, 2) AS min, round(hi, 2) AS max,
CASE WHEN {like_any(C.MONEY_NAMES)} THEN 'financial' ELSE 'numeric' END AS kpi_type, CASE WHEN {like_any(C.MONEY_NAMES)} THEN {MONEY.format(x='total')} END AS formatted_total
FROM ({over(NUM, 'CAST(sum({c}) AS DOUBLE) AS total, avg({c}) AS mean, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med, stddev_samp({c}) AS sd, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi', SRC)})"""
_FEW = [c for c in TEXT if c in ("status", "is_urgent", "note", "city", "constant_flag")]
QUERIES["n2_category_distribution"] = lambda s, d: N.category_distribution(scored(s, d))
ORACLES["n2_category_distribution"] = ranked_values(_FEW, SRC, 10)
QUERIES["n3_extreme_values"] = lambda s, d: N.extreme_values(scored(s, d))
ORACLES["n3_extreme_values"] = "SELECT * FROM (" + union_all([
    f"""SELECT '{c}' AS column_name, count(*) AS extreme_count, round(count(*) * 100.0 / any_value(n), 2) AS extreme_pct, round(CAST(min({c}) AS DOUBLE), 2) AS min_extreme,
 round(CAST(max({c}) AS DOUBLE), 2) AS max_extreme, round(any_value(med), 2) AS median_value FROM {SRC}, (SELECT count({c}) AS n, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med,
 quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {SRC}) WHERE {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)""" for c in NUM]) + ") WHERE extreme_count > 0"


def money(s, d):
    from pyspark.sql import functions as F

    return table(s, d, "orders").select("o_orderkey", N.format_money(F.col("o_totalprice") * F.col("o_custkey")).alias("shown"),
                                        N.format_money(F.col("o_totalprice") / 100).alias("small"))


QUERIES["n4_format_money"] = money
ORACLES["n4_format_money"] = f"SELECT o_orderkey, {MONEY.format(x='(o_totalprice * o_custkey)')} AS shown, {MONEY.format(x='(o_totalprice / 100)')} AS small FROM orders"
QUERIES["n5_top_n_by_group"] = lambda s, d: N.top_n_by_group(table(s, d, "orders"), "o_custkey")
ORACLES["n5_top_n_by_group"] = "SELECT o_custkey AS category, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC, category LIMIT 10"
QUERIES["n6_bottom_n_by_group"] = lambda s, d: N.bottom_n_by_group(table(s, d, "orders"), "o_custkey")
ORACLES["n6_bottom_n_by_group"] = "SELECT o_custkey AS category, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total, category LIMIT 10"
QUERIES["n5_top_default_columns"] = lambda s, d: N.top_n_by_group(scored(s, d))
ORACLES["n5_top_default_columns"] = f"SELECT customer_ref AS category, round(sum(total_amount), 2) AS total FROM {SRC} WHERE customer_ref IS NOT NULL GROUP BY 1 ORDER BY total DESC, category LIMIT 10"
QUERIES["n7_notable_correlations"] = lambda s, d: N.notable_correlations(correlated(s, d))
ORACLES["n7_notable_correlations"] = f"""SELECT col1, col2, round(r, 2) AS correlation, CASE WHEN abs(r) > 0.7 THEN 'Strong' ELSE 'Moderate' END AS strength,
CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM ({pair_sql(CORR_COLUMNS, CORR_SOURCE)}) WHERE abs(r) > 0.3 ORDER BY abs(r) DESC, col1, col2 LIMIT 8"""
QUERIES["n8_describe_numeric_column"] = lambda s, d: N.describe_column(scored(s, d), "total_amount")
ORACLES["n8_describe_numeric_column"] = f"""WITH a AS (SELECT CAST(count(total_amount) AS DOUBLE) AS count, avg(total_amount) AS mean, quantile_cont(total_amount, 0.5) AS median, stddev_samp(total_amount) AS std,
min(total_amount) AS min, max(total_amount) AS max, CAST(count(*) - count(total_amount) AS DOUBLE) AS missing, round((count(*) - count(total_amount)) * 100.0 / count(*), 1) AS missing_pct FROM {SRC})
""" + union_all([f"SELECT '{k}' AS item, round({k}, 2) AS value FROM a" for k in ("count", "mean", "median", "std", "min", "max", "missing", "missing_pct")])
QUERIES["n8_describe_text_column"] = lambda s, d: N.describe_column(scored(s, d), "city")
ORACLES["n8_describe_text_column"] = f"""SELECT 'unique' AS item, CAST(count(DISTINCT city) AS DOUBLE) AS value FROM {SRC} UNION ALL SELECT 'missing', CAST(count(*) - count(city) AS DOUBLE) FROM {SRC}
UNION ALL SELECT 'missing_pct', round((count(*) - count(city)) * 100.0 / count(*), 1) FROM {SRC}
UNION ALL SELECT * FROM (SELECT concat('value: ', city), CAST(count(*) AS DOUBLE) AS n FROM {SRC} GROUP BY city ORDER BY n DESC, city LIMIT 10)"""
QUERIES["n9_missing_report"] = lambda s, d: N.missing_report(scored(s, d))
ORACLES["n9_missing_report"] = f"SELECT column_name, missing, round(missing * 100.0 / n, 1) AS missing_pct, round(missing * 100.0 / (n * {len(ALL)}), 2) AS share_of_cells FROM ({MISSING}) WHERE missing > 0"


def shape_report(s, d):
    from tablewright.operators.profile import overview

    return overview(table(s, d, "documents").select("text", "lang")).select("rows", "cols", "total_duplicates")


QUERIES["n10_duplicate_shape_report"] = shape_report
ORACLES["n10_duplicate_shape_report"] = """SELECT count(*) AS "rows", CAST(2 AS BIGINT) AS cols, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS total_duplicates FROM documents"""
QUERIES["n11_outlier_report"] = lambda s, d: N.outlier_report(scored(s, d))
ORACLES["n11_outlier_report"] = f"SELECT column_name, outliers, round(outliers * 100.0 / n, 1) AS outlier_pct, round(lo, 2) AS lower_bound, round(hi, 2) AS upper_bound FROM ({OUT}) WHERE outliers > 0"
QUERIES["n12_priority_fixes"] = lambda s, d: N.priority_fixes(profile(s, d), AS_OF).select("id", "severity", "column_name")
ORACLES["n12_priority_fixes"] = f"""SELECT id, severity, column_name FROM ({ALL_THREATS}) ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, confidence DESC, id LIMIT 3"""
QUERIES["n13_weakest_dimensions"] = lambda s, d: N.weakest_dimensions(profile(s, d), AS_OF)
ORACLES["n13_weakest_dimensions"] = DIMENSIONS + "SELECT dimension, round(score, 1) AS score FROM dims ORDER BY round(score, 1), position LIMIT 3"
_SUMMARY_STATS = {"mean": "avg({c})", "median": "quantile_cont(CAST({c} AS DOUBLE), 0.5)", "min": "CAST(min({c}) AS DOUBLE)", "max": "CAST(max({c}) AS DOUBLE)"}
QUERIES["n14_dataset_summary"] = lambda s, d: N.dataset_summary(profile(s, d))
ORACLES["n14_dataset_summary"] = f"""SELECT 'size' AS section, 'rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM {SRC} UNION ALL SELECT 'size', 'cols', CAST({len(ALL)} AS DOUBLE)
UNION ALL SELECT 'missing', 'cells', CAST(sum(missing) AS DOUBLE) FROM ({MISSING}) UNION ALL SELECT 'missing', 'pct', round(sum(missing) * 100.0 / sum(n), 2) FROM ({MISSING})
UNION ALL SELECT 'duplicates', 'rows', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {SRC})) AS DOUBLE) FROM {SRC}
UNION ALL """ + union_all([f"SELECT '{c}', '{k}', round({e.format(c=c)}, 2) FROM {SRC}" for c in NUM for k, e in _SUMMARY_STATS.items()])
QUERIES["n15_report_facts"] = lambda s, d: N.report_facts(profile(s, d), AS_OF)
_MONEY_COLUMNS = [c for c in NUM if any(w in c for w in C.REPORT_MONEY_NAMES)]
ORACLES["n15_report_facts"] = DIMENSIONS + f""", th AS ({ALL_THREATS}), ov AS (SELECT sum(score * weight) AS o FROM dims)
SELECT 'size' AS section, 'rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM {SRC} UNION ALL SELECT 'size', 'cols', CAST({len(ALL)} AS DOUBLE)
UNION ALL SELECT 'effort', 'analyst_hours_saved', CAST(greatest(5, count(*) // 500) AS DOUBLE) FROM {SRC}
UNION ALL """ + union_all([f"SELECT 'money', '{c} {k}', round(CAST({e.format(c=c)} AS DOUBLE), 2) FROM {SRC}" for c in _MONEY_COLUMNS
                           for k, e in (("total", "sum({c})"), ("mean", "avg({c})"), ("median", "quantile_cont({c}, 0.5)"))]) + f"""
UNION ALL """ + union_all([f"""SELECT 'category', '{c}', CAST(count(DISTINCT {c}) AS DOUBLE) FROM {SRC} HAVING count(DISTINCT {c}) BETWEEN 1 AND 20
UNION ALL SELECT * FROM (SELECT 'category', concat('{c} = ', {c}), CAST(count(*) AS DOUBLE) AS n FROM {SRC} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 3) WHERE (SELECT count(DISTINCT {c}) FROM {SRC}) BETWEEN 1 AND 20"""
                           for c, k in ALL.items() if k == "text"]) + f"""
UNION ALL SELECT 'score', concat('overall ', {GRADE.format(x='o')}), round(o, 1) FROM ov
UNION ALL SELECT 'threats', 'total', CAST(count(*) AS DOUBLE) FROM th
UNION ALL SELECT 'threats', 'critical', CAST(count(*) FILTER (WHERE severity = 'critical') AS DOUBLE) FROM th
UNION ALL SELECT 'threats', 'warning', CAST(count(*) FILTER (WHERE severity = 'warning') AS DOUBLE) FROM th
UNION ALL SELECT 'dimension', dimension, round(score, 1) FROM dims"""
QUERIES["n16_histograms"] = lambda s, d: N.histograms(table(s, d, "lineitem"))
ORACLES["n16_histograms"] = "SELECT column_name, CAST(bin AS INTEGER) AS bin, count(*) AS n FROM (" + union_all([
    f"""SELECT '{c}' AS column_name, k - CASE WHEN v < a + k * ((b - a) / 30) THEN 1 ELSE 0 END + CASE WHEN k < 29 AND v >= a + (k + 1) * ((b - a) / 30) THEN 1 ELSE 0 END AS bin FROM (
 SELECT v, a, b, least(29, floor((v - a) * (30.0::DOUBLE / (b - a)))) AS k FROM (SELECT CAST({c} AS DOUBLE) AS v, CAST(min({c}) OVER () AS DOUBLE) AS a, CAST(max({c}) OVER () AS DOUBLE) AS b FROM lineitem))"""
    for c in LINEITEM_NUMBERS]) + ") GROUP BY ALL"
QUERIES["n17_correlation_matrix"] = lambda s, d: N.correlation_matrix(table(s, d, "lineitem"))
ORACLES["n17_correlation_matrix"] = f"SELECT col2 AS row_column, col1 AS col_column, round(r, 2) + 0 AS r FROM ({pair_sql(LINEITEM_NUMBERS, 'lineitem')})"
QUERIES["n18_describe_all"] = lambda s, d: N.describe_all(profile(s, d))
ORACLES["n18_describe_all"] = union_all([
    f"""SELECT '{c}' AS column_name, count({c}) AS count, CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std,
 round(CAST(min({c}) AS DOUBLE), 2) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 2) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 2) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 2) AS p75,
 round(CAST(max({c}) AS DOUBLE), 2) AS max FROM {SRC}""" if k == "numeric" else
    f"""SELECT '{c}', count({c}), {'count(DISTINCT ' + c + ')' if k == 'text' else 'NULL'}, """
    + (f"(SELECT {c} FROM {SRC} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1), (SELECT count(*) AS k FROM {SRC} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY k DESC LIMIT 1)" if k == "text" else "NULL, NULL")
    + f", NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {SRC}" for c, k in ALL.items()])


# Rules that the scored table never trips, over planted values ------------------------------------
_PLANTED = {"order_id": "o_orderkey", "price": "CASE WHEN o_custkey % 50 = 0 THEN o_totalprice * 20 ELSE o_totalprice END",
            "code": "CASE WHEN o_orderkey % 2 = 0 THEN concat('x', CAST(o_orderkey % 90 AS STRING)) ELSE CAST(o_orderkey % 90 AS STRING) END"}
_PSRC = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _PLANTED.items()) + " FROM orders)"


def planted(s, d):
    return table(s, d, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _PLANTED.items()])


_POUT, _PFAR = fences(["order_id", "price"], _PSRC, "1.5"), fences(["order_id", "price"], _PSRC, "3")
QUERIES["n11_outlier_report_planted"] = lambda s, d: N.outlier_report(planted(s, d))
ORACLES["n11_outlier_report_planted"] = ORACLES["n11_outlier_report"].replace(OUT, _POUT)
QUERIES["t5_outliers_planted"] = lambda s, d: T.outlier_threats(measure(planted(s, d))).select(*BRIEF)
ORACLES["t5_outliers_planted"] = THREAT_PARTS["t5_outliers"].replace(OUT, _POUT)
QUERIES["t4_mixed_types_planted"] = lambda s, d: T.mixed_type_threats(measure(planted(s, d))).select(*BRIEF)
ORACLES["t4_mixed_types_planted"] = f"""SELECT 'mt_code' AS id, 'critical' AS severity, 'Mixed data types in code' AS title, 'code' AS column_name, 'Data Quality' AS category, CAST(91 AS INTEGER) AS confidence
FROM (SELECT count(*) FILTER (WHERE o_orderkey % 2 <> 0) * 100.0 / count(*) AS pct FROM orders) WHERE pct > 20 AND pct < 95"""
QUERIES["n3_extreme_values_planted"] = lambda s, d: N.extreme_values(planted(s, d))
ORACLES["n3_extreme_values_planted"] = f"""WITH f AS (SELECT q1 - 3 * (q3 - q1) AS low, q3 + 3 * (q3 - q1) AS high, m FROM (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.75) AS q3 FROM {_PSRC}))
SELECT 'price' AS column_name, count(*) FILTER (WHERE price < low OR price > high) AS extreme_count, round(count(*) FILTER (WHERE price < low OR price > high) * 100.0 / count(*), 2) AS extreme_pct,
round(min(price) FILTER (WHERE price < low OR price > high), 2) AS min_extreme, round(max(price) FILTER (WHERE price < low OR price > high), 2) AS max_extreme, round(any_value(m), 2) AS median_value FROM {_PSRC}, f"""
QUERIES["n2_category_summary"] = lambda s, d: N.category_summary(scored(s, d))
ORACLES["n2_category_summary"] = union_all([
    f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS "distinct", (SELECT {c} FROM {SRC} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,
(SELECT count(*) AS k FROM {SRC} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY k DESC LIMIT 1) AS mode_count, count(DISTINCT {c}) <= 50 AS listed FROM {SRC} HAVING count({c}) > 0""" for c in TEXT])


def duplicate_share(s, d):
    from tablewright.operators.profile import duplicate_summary

    return duplicate_summary(table(s, d, "documents").select("text", "lang"))


QUERIES["n10_duplicate_share"] = duplicate_share
ORACLES["n10_duplicate_share"] = """SELECT k AS exact_duplicates, round(k * 100.0 / n, 2) AS duplicate_pct, CASE WHEN k / n > 0.05 THEN 'critical' WHEN k > 0 THEN 'warning' ELSE 'none' END AS severity
FROM (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS k FROM documents)"""
