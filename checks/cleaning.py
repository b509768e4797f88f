"""Cleaner, correction and plan-driven fix checks over the dirty orders view."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import DIRTY_ORDERS, dirty_orders, dirty_orders_sql, quoted, table, union_all
from tablewright.functions import constants as C
from tablewright.operators import cleaners as X
from tablewright.operators import correct
from tablewright.plans import cleaning

QUERIES, ORACLES = {}, {}
EDGE = quoted(C.SPACE_CHARACTERS)


def strip(x):
    return f"trim({x}, {EDGE})"


def number(x):
    return f"CASE WHEN regexp_matches({strip(x)}, {quoted(C.NUMBER)}) THEN CAST({strip(x)} AS DOUBLE) END"


def tokens(words):
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def replace_chain(x, pairs):
    for a, b in pairs:
        a = "chr(0)" if a == "\x00" else quoted(a)
        x = f"replace({x}, {a}, {quoted(b)})"
    return x


def nullify(x):
    return f"CASE WHEN lower({strip(x)}) IN {tokens(C.NULL_TOKENS)} THEN NULL ELSE {x} END"


def space(x):
    x = f"replace({x}, ' ', ' ')"
    for z in "​‌‍﻿":
        x = f"replace({x}, '{z}', '')"
    x = f"regexp_replace({x}, '[\\t\\r\\n]+', ' ', 'g')"
    return strip(f"regexp_replace({x}, {quoted(C.SPACE + '{2,}')}, ' ', 'g')")


def base(c):
    return space(nullify(c))


def dates(x):
    def at(shape, *formats):
        return f"WHEN regexp_matches({x}, '{shape}') THEN coalesce(" + ", ".join(f"try_strptime({x}, '{f}')" for f in formats) + ")"
    return ("CASE " + at(r"^\d{4}-\d{1,2}-\d{1,2}$", "%Y-%m-%d") + " " + at(r"^\d{1,2}/\d{1,2}/\d{4}$", "%m/%d/%Y", "%d/%m/%Y") + " "
            + at(r"^\d{1,2}-\d{1,2}-\d{4}$", "%m-%d-%Y", "%d-%m-%Y") + " " + at(r"^\d{1,2}\.\d{1,2}\.\d{4}$", "%m.%d.%Y", "%d.%m.%Y") + " "
            + at(r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "%b %d, %Y") + " END")


def boolean(x):
    return f"CASE WHEN lower({strip(x)}) IN {tokens(C.TRUE_TOKENS)} THEN true WHEN lower({strip(x)}) IN {tokens(C.FALSE_TOKENS)} THEN false END"


def year(x):
    n = f"TRY_CAST(regexp_replace({strip(x)}, '\\.0$', '') AS DOUBLE)"
    n = f"CASE WHEN {n} <= 30 THEN {n} + 2000 WHEN {n} <= 99 THEN {n} + 1900 ELSE {n} END"
    return f"CAST(CASE WHEN {n} BETWEEN 1900 AND 2100 THEN {n} END AS INTEGER)"


def phone(x):
    return f"regexp_replace({strip(x)}, '[\\s\\-\\.\\(\\)]', '', 'g')"


def parens(x):
    return f"CASE WHEN regexp_matches({x}, {quoted(C.PAREN_NUMBER)}) THEN -CAST(regexp_replace({x}, '[\\(\\)\\$₹£€¥,\\s]', '', 'g') AS DOUBLE) ELSE {number(x)} END"


def email(x):
    out = f"lower({strip(x)})"
    for bad, good in C.EMAIL_DOMAIN_FIXES.items():
        out = f"regexp_replace({out}, '@{bad}$', '@{good}')"
    return out


def prefix(x):
    import re
    alternation = "|".join(re.escape(p).replace("\\ ", " ") for p in C.LABEL_PREFIXES)
    return strip(f"regexp_replace({strip(x)}, '(?i)^({alternation})', '')")


def rating(x):
    return f"TRY_CAST(nullif(regexp_extract({strip(x)}, {quoted(C.RATING)}, 1), '') AS DOUBLE)"


def mojibake(x):
    return f"replace({replace_chain(x, C.MOJIBAKE)}, ' ', ' ')"


def marks(x):
    return strip(f"regexp_replace({x}, {quoted(C.REFERENCE_MARK)}, '', 'g')")


def currency(x):
    return number(f"regexp_replace(regexp_replace({x}, '[\\$₹£€¥,\\s]', '', 'g'), {quoted(C.REFERENCE_MARK)}, '', 'g')")


def separated(x):
    return number(f"replace({x}, ',', '')")


def source(*columns):
    return f"({dirty_orders_sql('order_id', *columns)})"


def row_check(name, column, cleaner, sql):
    """One cleaner on one column: rows out, and the audit with the count of affected values."""
    QUERIES[name] = lambda s, d: cleaning.run_cleaners(dirty_orders(s, d, "order_id", column), [cleaner])[0]
    ORACLES[name] = f"SELECT order_id, {sql(column)} AS {column} FROM {source(column)}"


CASES = {
    "c1_null_strings": ("status", X.NULL_STRINGS, nullify),
    "c2_whitespace": ("priority", X.WHITESPACE, space),
    "c3_percentages": ("discount_text", X.PERCENTAGES, lambda c: number(f"replace(replace({c}, '%', ''), ',', '')")),
    "c4_booleans": ("is_urgent", X.BOOLEANS, boolean),
    "c5_years": ("order_year", X.YEARS, year),
    "c6_phones": ("contact_phone", X.PHONES, phone),
    "c7_indian_numbers": ("amount_inr", X.INDIAN_NUMBERS, separated),
    "c8_negative_parens": ("delta", X.NEGATIVE_PARENS, parens),
    "c9_emails": ("email", X.EMAILS, email),
    "c10_label_prefixes": ("author", X.TEXT_PREFIXES, prefix),
    "c11_dates": ("order_date", X.DATES, dates),
    "c12_ratings": ("rating", X.RATINGS, rating),
    "x3_fix_encoding": ("note", X.MOJIBAKE, mojibake),
    "x5_standardize_dates": ("order_date", X.STANDARD_DATES, lambda c: f"coalesce(strftime({dates(c)}, '%Y-%m-%d'), {c})"),
    "x8_strip_references": ("note", X.REFERENCES, marks),
    "x9_parse_currency": ("price_text", X.CURRENCY, currency),
    "x11_text_to_numeric": ("quantity_text", X.TEXT_TO_NUMERIC, separated),
    "x6_standardize_numbers": ("mixed_number", X.STANDARD_NUMBERS, lambda c: (
        f"CASE WHEN regexp_matches({c}, {quoted(C.EUROPEAN_NUMBER)}) THEN replace(replace({c}, '.', ''), ',', '.') ELSE replace({c}, ',', '') END")),
}
for _name, (_column, _cleaner, _sql) in CASES.items():
    row_check(_name, _column, _cleaner, _sql)

# Run everything over the whole view ------------------------------------------------------------
FINAL = {
    "order_id": "order_id", "customer_ref": base("customer_ref"), "status": base("status"), "priority": base("priority"),
    "total_amount": "total_amount", "price_text": base("price_text"),
    "discount_text": CASES["c3_percentages"][2](base("discount_text")), "is_urgent": boolean(base("is_urgent")),
    "order_year": year(base("order_year")), "contact_phone": phone(base("contact_phone")), "email": email(base("email")),
    "amount_inr": separated(base("amount_inr")), "delta": parens(base("delta")), "author": prefix(base("author")),
    "rating": rating(base("rating")), "order_date": dates(base("order_date")), "note": base("note"), "city": base("city"),
    "mixed_number": base("mixed_number"), "quantity_text": base("quantity_text"), "reference": base("reference"),
}
VIEW = list(DIRTY_ORDERS)
QUERIES["c13_run_all"] = lambda s, d: cleaning.run_cleaners(dirty_orders(s, d))[0]
ORACLES["c13_run_all"] = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in FINAL.items()) + f" FROM ({dirty_orders_sql()})"


def run_all_audit(s, d):
    return cleaning.audit_frame(s, cleaning.run_cleaners(dirty_orders(s, d))[1]).select("action", "column_name", "rows_affected", "confidence")


QUERIES["c13_run_all_audit"] = run_all_audit
_TEXT = [c for c in VIEW if c not in ("order_id", "total_amount")]
_FIRED = {  # column: (action, confidence, count condition on the cleaned text)
    "discount_text": ("CLEAN_PERCENTAGES", 94, f"regexp_matches({{x}}, {quoted(C.PERCENT)})"),
    "is_urgent": ("NORMALIZE_BOOLEANS", 93, f"lower({{x}}) IN {tokens(C.TRUE_TOKENS + C.FALSE_TOKENS)}"),
    "order_year": ("CLEAN_YEARS", 95, "true"),
    "contact_phone": ("NORMALIZE_PHONES", 90, "regexp_matches({x}, '[ .()-]')"),
    "email": ("NORMALIZE_EMAILS", 92, "{x} <> " + email("{x}")),
    "amount_inr": ("CLEAN_INDIAN_NUMBERS", 88, f"regexp_matches({{x}}, {quoted(C.INDIAN_NUMBER)})"),
    "delta": ("CLEAN_NEGATIVE_PARENS", 94, f"regexp_matches({{x}}, {quoted(C.PAREN_NUMBER)})"),
    "author": ("STRIP_TEXT_PREFIXES", 95, "{x} <> " + prefix("{x}")),
    "rating": ("EXTRACT_RATING", 97, f"regexp_matches({{x}}, {quoted(C.RATING)})"),
    "order_date": ("NORMALIZE_DATES", 90, dates("{x}") + " IS NOT NULL"),
}
ORACLES["c13_run_all_audit"] = "SELECT * FROM (" + union_all(
    [f"SELECT 'CLEAN_NULL_STRINGS' AS action, '{c}' AS column_name, count(*) FILTER (WHERE lower({strip(c)}) IN {tokens(C.NULL_TOKENS)}) AS rows_affected, CAST(96 AS INTEGER) AS confidence FROM ({dirty_orders_sql()})" for c in _TEXT]
    + [f"SELECT 'CLEAN_WHITESPACE', '{c}', count(*) FILTER (WHERE {space(nullify(c))} <> {nullify(c)}), 98 FROM ({dirty_orders_sql()})" for c in _TEXT]
    + [f"SELECT '{a}', '{c}', count(*) FILTER (WHERE {cond.replace('{x}', 'x')}), {k} FROM (SELECT {base(c)} AS x FROM ({dirty_orders_sql()}))"
       for c, (a, k, cond) in _FIRED.items()]) + ") WHERE rows_affected > 0"

# X17: the semantic subset, stopping at the first type change.
_SEMANTIC = ["order_id", "status", "discount_text", "is_urgent", "contact_phone", "email", "delta", "author", "rating", "order_year"]
QUERIES["x17_fix_semantic"] = lambda s, d: cleaning.run_cleaners(dirty_orders(s, d, *_SEMANTIC), X.SEMANTIC)[0]
ORACLES["x17_fix_semantic"] = "SELECT " + ", ".join(
    f"{base(c) if c == 'order_year' else FINAL[c]} AS {c}" for c in _SEMANTIC) + f" FROM ({dirty_orders_sql(*_SEMANTIC)})"

# Detection -----------------------------------------------------------------------------------
_DETECT = ["status", "price_text", "discount_text", "is_urgent", "delta", "note", "order_date", "mixed_number", "quantity_text", "email"]
_DSRC = f"({dirty_orders_sql(*_DETECT)})"


def messy_headers(s, d):
    t = table(s, d, "orders").toDF(" Order  Id ", "cafÃ©", "cafÃ©", "", "Total Price", "unnamed")
    renamed, _ = correct.clean_column_names(t)
    return renamed.groupBy("unnamed_1").agg(F.count("café_1").alias("n"), F.round(F.sum(F.col("`Order Id`") * 1.0), 0).alias("ids"), F.max("unnamed").alias("price"))


QUERIES["x1_clean_column_names"] = messy_headers
ORACLES["x1_clean_column_names"] = "SELECT o_orderpriority AS unnamed_1, count(*) AS n, CAST(sum(o_orderkey) AS DOUBLE) AS ids, max(o_totalprice) AS price FROM orders GROUP BY 1"
QUERIES["x2_detect_encoding"] = lambda s, d: correct.detect_encoding(dirty_orders(s, d, "note", "city", "status"))
ORACLES["x2_detect_encoding"] = "SELECT * FROM (" + union_all([
    f"SELECT '{c}' AS column_name, p AS pattern, r AS replacement, CAST(sum((length({c}) - length(replace({c}, p, ''))) / length(p)) AS BIGINT) AS occurrences "
    f"FROM ({dirty_orders_sql('note', 'city', 'status')}), (VALUES {', '.join('(' + ('chr(0)' if a == chr(0) else quoted(a)) + ', ' + quoted(b) + ')' for a, b in C.MOJIBAKE)}) v(p, r) GROUP BY p, r"
    for c in ("note", "city", "status")]) + ") WHERE occurrences > 0"
QUERIES["x4_detect_format_mix"] = lambda s, d: correct.detect_format_mix(dirty_orders(s, d, *_DETECT))
_SHAPES = ", ".join(f"count(*) FILTER (WHERE regexp_matches({{c}}, {quoted(p)})) AS {n}" for n, p in zip(
    ("slash_dates", "iso_dates", "dot_dates", "comma_numbers", "dot_numbers"), [*C.DATE_SHAPES.values(), C.WESTERN_NUMBER, C.EUROPEAN_NUMBER]))
_MIX = union_all([f"SELECT '{c}' AS column_name, " + _SHAPES.replace("{c}", c) + f" FROM {_DSRC}" for c in _DETECT])
ORACLES["x4_detect_format_mix"] = f"""WITH m AS ({_MIX}) SELECT column_name, 'mixed_date_format' AS issue, * EXCLUDE (column_name) FROM m
WHERE CAST(slash_dates > 0 AS INTEGER) + CAST(iso_dates > 0 AS INTEGER) + CAST(dot_dates > 0 AS INTEGER) > 1
UNION ALL SELECT column_name, 'mixed_number_format', * EXCLUDE (column_name) FROM m WHERE comma_numbers > 0 AND dot_numbers > 0"""
QUERIES["x7_detect_type_issues"] = lambda s, d: correct.detect_type_issues(dirty_orders(s, d, *_DETECT))
_BARE = "regexp_replace(regexp_replace({c}, '[\\$₹£€¥,]', '', 'g'), " + quoted(C.REFERENCE_MARK) + ", '', 'g')"
ORACLES["x7_detect_type_issues"] = "SELECT column_name, issue, round(a, 2) AS currency_ratio, round(b, 2) AS reference_ratio, round(c, 2) AS numeric_ratio FROM (SELECT *, CASE WHEN a > 0.3 AND c > 0.5 THEN 'currency_as_string' WHEN b > 0.1 THEN 'embedded_references' WHEN c > 0.7 THEN 'numeric_as_string' END AS issue FROM (" + union_all([
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE regexp_matches({c}, {quoted(C.CURRENCY)})) / count({c}) AS a, count(*) FILTER (WHERE regexp_matches({c}, {quoted(C.REFERENCE_MARK)})) / count({c}) AS b, "
    f"count({number(_BARE.replace('{c}', c))}) / count({c}) AS c FROM {_DSRC}" for c in _DETECT]) + ")) WHERE issue IS NOT NULL"
QUERIES["x16_detect_semantic_issues"] = lambda s, d: correct.detect_semantic_issues(dirty_orders(s, d, *_DETECT))
_SEM = {"null_strings": (f"lower({strip('{c}')}) IN {tokens(C.NULL_TOKENS)}", "n > 0"),
        "percentage_strings": (f"regexp_matches({strip('{c}')}, {quoted(C.PERCENT)})", "n / present > 0.4"),
        "boolean_strings": (f"lower({strip('{c}')}) IN {tokens(C.TRUE_TOKENS + C.FALSE_TOKENS)}", "n / present > 0.7"),
        "negative_parentheses": (f"regexp_matches({strip('{c}')}, {quoted(C.PAREN_NUMBER)})", "n >= 2 AND n / present > 0.05")}
ORACLES["x16_detect_semantic_issues"] = union_all([
    f"SELECT column_name, '{k}' AS issue, n AS count, round(n / present, 2) AS ratio FROM (" + union_all([
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {cond.replace('{c}', c)}) AS n, count({c}) AS present FROM {_DSRC}" for c in _DETECT])
    + f") WHERE {rule}" for k, (cond, rule) in _SEM.items()])
QUERIES["x12_drop_empty_reference_columns"] = lambda s, d: correct.drop_empty_reference_columns(dirty_orders(s, d, "order_id", "reference", "status"))[0]
ORACLES["x12_drop_empty_reference_columns"] = dirty_orders_sql("order_id", "status")

# Corrections and merges ----------------------------------------------------------------------
_CORRECTIONS = [("city", "New Yorkk", "New York"), ("city", "Chcago", "Chicago"), ("status", "N/A", "O"), ("city", "Nowhere", "X")]


def corrections(s):
    return s.createDataFrame(_CORRECTIONS, "column_name string, old_value string, new_value string")


QUERIES["x10_apply_corrections"] = lambda s, d: correct.apply_corrections(dirty_orders(s, d, "order_id", "city", "status"), corrections(s))
ORACLES["x10_apply_corrections"] = f"""SELECT order_id, CASE city WHEN 'New Yorkk' THEN 'New York' WHEN 'Chcago' THEN 'Chicago' ELSE city END AS city,
CASE status WHEN 'N/A' THEN 'O' ELSE status END AS status FROM {source('city', 'status')}"""
QUERIES["x10_correction_counts"] = lambda s, d: correct.correction_counts(dirty_orders(s, d, "order_id", "city", "status"), corrections(s))
ORACLES["x10_correction_counts"] = union_all([f"SELECT '{c}' AS column_name, {quoted(o)} AS old_value, {quoted(n)} AS new_value, count(*) AS rows_affected FROM {source('city', 'status')} WHERE {c} = {quoted(o)} HAVING count(*) > 0" for c, o, n in _CORRECTIONS])
_VARIANTS = union_all([f"SELECT '{c}' AS column_name, value AS old_value, new_value, n, CAST(0.95 AS DOUBLE) AS confidence, 'case_variant' AS type FROM (SELECT value, n, "
                       f"first_value(value) OVER (PARTITION BY lower({strip('value')}) ORDER BY n DESC, value) AS new_value FROM (SELECT {c} AS value, count(*) AS n FROM {_DSRC.replace('SELECT ', 'SELECT ' + DIRTY_ORDERS['city'] + ' AS city, ', 1)} WHERE {c} IS NOT NULL GROUP BY {c})) WHERE value <> new_value"
                       for c in ("city", "status", "note")])
_MERGE = ["order_id", "city", "status", "note"]
QUERIES["x13_case_variant_merges"] = lambda s, d: correct.case_variant_merges(dirty_orders(s, d, *_MERGE))
ORACLES["x13_case_variant_merges"] = _VARIANTS
QUERIES["x14_fuzzy_merges"] = lambda s, d: correct.fuzzy_merges(dirty_orders(s, d, *_MERGE))
# Spellings that belong together, each with the likeness of its plain forms.
_ALIKE = [("new york", "new yorkk", 0.94), ("new york", "york new", 1.0), ("new yorkk", "york new", 0.94), ("san francisco", "san fransisco", 0.92), ("acme inc", "the acme", 1.0), ("chicago", "chcago", 0.92)]


def fuzzy_sql(table):
    """Similar spellings of a table's city column, as the merges define them."""
    return f"""SELECT 'city' AS column_name, old_value, new_value, n, confidence, 'fuzzy_merge' AS type FROM (
WITH counts AS (SELECT city AS value, lower({strip('city')}) AS form, count(*) AS n FROM {table} GROUP BY 1, 2),
kept AS (SELECT * FROM (SELECT *, first_value(value) OVER (PARTITION BY form ORDER BY n DESC, value) AS best FROM counts) WHERE value = best),
alike(a, b, r) AS (VALUES {', '.join(f"('{a}', '{b}', {r}::DOUBLE), ('{b}', '{a}', {r}::DOUBLE)" for a, b, r in _ALIKE)}),
met AS (SELECT o.value AS old_value, w.value AS new_value, o.n, r AS confidence, row_number() OVER (PARTITION BY o.value ORDER BY r DESC, w.n DESC, w.value) AS k
 FROM kept o JOIN alike ON o.form = a JOIN kept w ON w.form = b WHERE w.n > o.n OR (w.n = o.n AND w.value < o.value))
SELECT * FROM met WHERE k = 1 AND new_value NOT IN (SELECT old_value FROM met WHERE k = 1))"""


_FUZZY = fuzzy_sql(source('city'))
ORACLES["x14_fuzzy_merges"] = _FUZZY
QUERIES["x15_merge_case_variants"] = lambda s, d: correct.merge_categories(dirty_orders(s, d, *_MERGE), fuzzy=False)[0]
ORACLES["x15_merge_case_variants"] = f"""WITH m AS ({_VARIANTS}) SELECT order_id, coalesce(a.new_value, city) AS city, coalesce(b.new_value, status) AS status, note FROM {source('city', 'status', 'note')}
LEFT JOIN (SELECT * FROM m WHERE column_name = 'city') a ON city = a.old_value LEFT JOIN (SELECT * FROM m WHERE column_name = 'status') b ON status = b.old_value"""
QUERIES["x15_merge_categories"] = lambda s, d: correct.merge_categories(dirty_orders(s, d, *_MERGE))[0].groupBy("city", "status", "note").agg(F.count("*").alias("n"))
ORACLES["x15_merge_categories"] = f"""WITH m AS ({_VARIANTS} UNION ALL {_FUZZY}) SELECT coalesce(a.new_value, city) AS city, coalesce(b.new_value, status) AS status, note, count(*) AS n FROM {source('city', 'status', 'note')}
LEFT JOIN (SELECT * FROM m WHERE column_name = 'city') a ON city = a.old_value LEFT JOIN (SELECT * FROM m WHERE column_name = 'status') b ON status = b.old_value GROUP BY 1, 2, 3"""


def wide_categories(s, d):
    """Part names with planted variants: more spellings than any narrow column has."""
    names = table(s, d, "part").select(F.concat(F.lit("maker "), F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("name"))
    return correct.case_variant_merges(names.union(names.select(F.upper("name"))).union(names.select(F.upper("name"))))


QUERIES["x13_case_variants_of_a_wide_column"] = wide_categories
ORACLES["x13_case_variants_of_a_wide_column"] = """SELECT 'name' AS column_name, name AS old_value, upper(name) AS new_value, n, CAST(0.95 AS DOUBLE) AS confidence, 'case_variant' AS type
FROM (SELECT concat('maker ', p_name, ' ', p_partkey) AS name, count(*) AS n FROM part GROUP BY 1)"""
# Long and short names with two edits each: a replaced letter at two places of 160 letters, two swaps in 14.
_LETTERS = "translate(md5(concat('{}', cast(p_partkey AS STRING))), '0123456789', 'ghijklmnop')"
_NAME160 = "concat(" + ", ".join(_LETTERS.format(x) for x in "abcde") + ", ' ', cast(p_partkey AS STRING))"
_EDITED = f"concat(substr({_NAME160}, 1, 39), 'z', substr({_NAME160}, 41, 79), 'y', substr({_NAME160}, 121))"
_SWAPS = [("concat('abcdefghijklmn ', cast(p_partkey AS STRING))", "concat('bacdefghijlkmn ', cast(p_partkey AS STRING))"), (_NAME160, _EDITED)]


def two_edits(s, d):
    """Every right spelling twice and its variant once, long and short ones in one column."""
    parts = table(s, d, "part")
    rows = [parts.selectExpr(f"{e} AS name") for right, wrong in _SWAPS for e in (right, right, wrong)]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return correct.fuzzy_merges(out)


QUERIES["x14_fuzzy_merges_of_a_wide_column"] = two_edits
ORACLES["x14_fuzzy_merges_of_a_wide_column"] = f"""SELECT 'name' AS column_name, {_SWAPS[0][1]} AS old_value, {_SWAPS[0][0]} AS new_value, CAST(1 AS BIGINT) AS n,
round((13 + length(CAST(p_partkey AS VARCHAR))) / (15 + length(CAST(p_partkey AS VARCHAR))), 2) AS confidence, 'fuzzy_merge' AS type FROM part
UNION ALL SELECT 'name', {_SWAPS[1][1]}, {_SWAPS[1][0]}, 1, round((159 + length(CAST(p_partkey AS VARCHAR))) / (161 + length(CAST(p_partkey AS VARCHAR))), 2), 'fuzzy_merge' FROM part"""
QUERIES["x20_value_frequency_sample"] = lambda s, d: correct.value_frequency_sample(dirty_orders(s, d, "status", "city", "customer_ref"))
ORACLES["x20_value_frequency_sample"] = union_all([
    f"SELECT '{c}' AS column_name, value, n FROM (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS a, row_number() OVER (ORDER BY n, value DESC) AS b FROM "
    f"(SELECT {c} AS value, count(*) AS n FROM {source('status', 'city', 'customer_ref')} WHERE {c} IS NOT NULL GROUP BY {c})) WHERE a <= 15 OR b <= 15" for c in ("status", "city", "customer_ref")])
QUERIES["x20_value_frequency_draw"] = lambda s, d: correct.value_frequency_draw(dirty_orders(s, d, "status", "city", "customer_ref"), seed=7)
ORACLES["x20_value_frequency_draw"] = union_all([
    f"""SELECT '{c}' AS column_name, value, n, CASE WHEN a <= 10 THEN 'head' ELSE 'draw' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY a <= 10 ORDER BY md5(concat('7:', value))) AS b FROM (
SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS a FROM (SELECT {c} AS value, count(*) AS n FROM {source('status', 'city', 'customer_ref')} WHERE {c} IS NOT NULL GROUP BY {c}))) WHERE a <= 10 OR b <= 5""" for c in ("status", "city", "customer_ref")])
QUERIES["x19_analyze"] = lambda s, d: correct.analyze(dirty_orders(s, d, *_DETECT), fuzzy=False)
ORACLES["x19_analyze"] = f"""SELECT column_name, 'encoding' AS area, 'broken_sequences' AS issue, CAST(sum(occurrences) AS BIGINT) AS count FROM ({ORACLES['x2_detect_encoding']}) WHERE column_name = 'note' GROUP BY 1
UNION ALL SELECT column_name, 'format', issue, CAST(1 AS BIGINT) FROM ({ORACLES['x4_detect_format_mix']})
UNION ALL SELECT column_name, 'type', issue, CAST(1 AS BIGINT) FROM ({ORACLES['x7_detect_type_issues']})
UNION ALL SELECT column_name, 'semantic', issue, count FROM ({ORACLES['x16_detect_semantic_issues']})
UNION ALL SELECT column_name, 'category', type, count(*) FROM ({_VARIANTS}) WHERE column_name IN ('status', 'note') GROUP BY 1, 3"""

# Plan-driven fixes ---------------------------------------------------------------------------
FIXES = {
    "l1_strip_prefix": ("author", {"fix_type": "strip_prefix", "prefix_patterns": ["Written by:", "narratedby:"]},
                        lambda c: strip(f"regexp_replace({strip(c)}, '(?i)^(written by:|narratedby:)', '')")),
    "l2_strip_suffix": ("rating", {"fix_type": "strip_suffix", "suffix_pattern": r"\s+ratings$"}, lambda c: strip(f"regexp_replace({c}, '\\s+ratings$', '', 'g')")),
    "l3_extract_number": ("rating", {"fix_type": "extract_number", "extract_regex": r"^([0-9.]+) OUT of"},
                          lambda c: number(f"CASE WHEN regexp_matches({c}, '(?i)^([0-9.]+) OUT of') THEN regexp_extract({c}, '(?i)^([0-9.]+) OUT of', 1) ELSE {c} END")),
    "l4_to_numeric": ("price_text", {"fix_type": "to_numeric", "strip_chars": "$,"}, lambda c: number(f"replace(replace({c}, '$', ''), ',', '')")),
    "l5_to_null": ("status", {"fix_type": "to_null", "null_strings": ["n/a", "Unknown"]}, lambda c: f"CASE WHEN lower({strip(c)}) IN ('n/a', 'unknown') THEN NULL ELSE {c} END"),
    "l6_regex_replace": ("note", {"fix_type": "regex_replace", "find": r"plain note (\d+)", "replace": r"Note \1"}, lambda c: f"coalesce(nullif({strip(f'regexp_replace({c}, $$(?i)plain note (\\d+)$$, $$Note \\1$$, $$g$$)')}, ''), {c})"),
    "l7_map_values": ("city", {"fix_type": "map_values", "mapping": {"NEW YORK": "NYC", "Chcago": "Chicago"}}, lambda c: f"CASE lower({strip(c)}) WHEN 'new york' THEN 'NYC' WHEN 'chcago' THEN 'Chicago' ELSE {c} END"),
    "l8_to_boolean": ("is_urgent", {"fix_type": "to_boolean", "true_values": ["YES"], "false_values": ["no"]}, lambda c: f"CASE lower({strip(c)}) WHEN 'yes' THEN true WHEN 'no' THEN false END"),
    "l9_normalise_case": ("city", {"fix_type": "normalise_case", "case_style": "upper"}, lambda c: f"upper({strip(c)})"),
    "l10_deduplicate_words": ("doubled", {"fix_type": "deduplicate_words"}, lambda c: "CASE WHEN lower(city) = 'boston' THEN 'Boston city City2' ELSE 'red Blue red' END"),
}
_DOUBLED = "CASE WHEN o_orderkey % 16 = 13 THEN 'Boston BOSTON  city City City2' ELSE 'red RED Blue red' END"


def fixed(s, d, column, fix):
    t = table(s, d, "orders").selectExpr(f"{DIRTY_ORDERS['order_id']} AS order_id", f"{_DOUBLED if column == 'doubled' else DIRTY_ORDERS[column]} AS {column}")
    return cleaning.apply_fixes(t, {column: [{**fix, "confidence": 0.9}]})[0]


for _name, (_column, _fix, _sql) in FIXES.items():
    QUERIES[_name] = lambda s, d, c=_column, f=_fix: fixed(s, d, c, f)
    ORACLES[_name] = f"SELECT order_id, {_sql(_column)} AS {_column} FROM {source('city' if _column == 'doubled' else _column)}"


def several_fixes(s, d):
    fixes = {"author": [{**FIXES["l1_strip_prefix"][1], "confidence": 0.9}, {"fix_type": "normalise_case", "case_style": "lower", "confidence": 0.8}],
             "price_text": [{**FIXES["l4_to_numeric"][1], "confidence": 0.95}],
             "city": [{"fix_type": "normalise_case", "case_style": "upper", "confidence": 0.5}]}
    return cleaning.apply_fixes(dirty_orders(s, d, "order_id", "author", "price_text", "city"), fixes)[0]


QUERIES["l_apply_plan"] = several_fixes
ORACLES["l_apply_plan"] = (f"SELECT order_id, lower({FIXES['l1_strip_prefix'][2]('author')}) AS author, {FIXES['l4_to_numeric'][2]('price_text')} AS price_text, city "
                           f"FROM {source('author', 'price_text', 'city')}")
