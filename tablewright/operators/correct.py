"""Structure, encoding, type and category correction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import constants as K
from tablewright.functions.text import col, name_has, norm, strip, to_double
from tablewright.operators import cleaners as C
from tablewright.operators import spelling
from tablewright.operators.profile import count_flags, folded_text, long_text, rows_frame, text_columns, value_key
from tablewright.session import cut_lineage


def _header(name: str) -> str:
    """A header without broken sequences and odd white space."""
    for bad, good in K.MOJIBAKE:
        name = name.replace(bad, good)
    return " ".join(name.replace("\u00a0", " ").split()) or "unnamed"


def clean_column_names(df: DataFrame) -> tuple[DataFrame, list[dict]]:
    """Repaired, stripped, unique headers. Metadata only.

    The first column of a name keeps it. Later ones get the smallest number that no column has, be it there from the start or given here.
    """
    wanted = [_header(name) for name in df.columns]
    taken, placed, names = set(wanted), set(), []
    for name in wanted:
        if name in placed:
            name = next(f"{name}_{i}" for i in range(1, len(wanted) + len(taken)) if f"{name}_{i}" not in taken)
            taken.add(name)
        placed.add(name)
        names.append(name)
    audit = [{"step": 0, "action": "CLEAN_COLUMN_NAMES", "rows_affected": 0, "confidence": 95, "source": "deterministic"}]
    return df.toDF(*names), audit if names != df.columns else []


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().replace("__", "_").lower() for c in df.columns])


def detect_encoding(df: DataFrame) -> DataFrame:
    """Occurrences of every broken sequence per text column, over whole columns."""
    long = long_text(df)
    patterns = [bad for bad, _ in K.MOJIBAKE]

    def occurrences(bad: str) -> Column:
        gone = F.replace(F.col("value"), F.lit(bad), F.lit(""))
        return (F.length("value") - F.length(gone)) / F.lit(len(bad))

    # Values without any of the sequences' first characters need no counting.
    starts = "[" + "".join(sorted({re.escape(b[0]) for b in patterns})) + "]"
    suspects = long.filter(F.col("value").rlike(starts))
    counted = suspects.select("column_name", *[occurrences(b).cast("long").alias(f"p{i}") for i, b in enumerate(patterns)])
    sums = counted.groupBy("column_name").agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(patterns))])
    cells = [F.struct(F.lit(b).alias("pattern"), F.lit(g).alias("replacement"), F.col(f"p{i}").alias("occurrences"))
             for i, (b, g) in enumerate(K.MOJIBAKE)]
    return (
        sums.select("column_name", F.explode(F.array(*cells)).alias("cell")).select("column_name", "cell.*")
        .filter("occurrences > 0"))


def fix_encoding(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    wanted = set(text_columns(df) if columns is None else columns)
    return df.select(*[C.MOJIBAKE.apply(col(c), {}, c).alias(c) if c in wanted else col(c) for c in df.columns])


def detect_format_mix(df: DataFrame) -> DataFrame:
    """Text columns that mix date shapes or number notations."""
    v = F.col("value")
    flags = {**C.date_shapes(v), "comma_numbers": v.rlike(K.WESTERN_NUMBER), "dot_numbers": v.rlike(K.EUROPEAN_NUMBER)}
    counted = count_flags(folded_text(df), flags)
    kinds = sum(((F.col(f"shape_{i}") > 0).cast("int") for i in range(3)), F.lit(0))
    issues = F.array(
        F.when(kinds > 1, "mixed_date_format"),
        F.when((F.col("comma_numbers") > 0) & (F.col("dot_numbers") > 0), "mixed_number_format"))
    return counted.select("column_name", F.explode(F.array_compact(issues)).alias("issue"),
                          *[F.col(f"shape_{i}").alias(n) for i, n in enumerate(("slash_dates", "iso_dates", "dot_dates"))],
                          "comma_numbers", "dot_numbers")


def detect_type_issues(df: DataFrame) -> DataFrame:
    v = F.col("value")
    bare = strip(F.regexp_replace(F.regexp_replace(v, r"[\$₹£€¥,]", ""), K.REFERENCE_MARK, ""))
    counted = count_flags(folded_text(df), {"present": v.isNotNull(), "currency": v.rlike(K.CURRENCY),
                                            "marks": v.rlike(K.REFERENCE_MARK), "numbers": to_double(bare).isNotNull()})
    currency, marks, numbers = (F.col(k) / F.col("present") for k in ("currency", "marks", "numbers"))
    issue = (F.when((currency > 0.3) & (numbers > 0.5), "currency_as_string").when(marks > 0.1, "embedded_references")
             .when(numbers > 0.7, "numeric_as_string"))
    return counted.filter("present > 0").select(
        "column_name", issue.alias("issue"), F.round(currency, 2).alias("currency_ratio"),
        F.round(marks, 2).alias("reference_ratio"), F.round(numbers, 2).alias("numeric_ratio")).filter("issue IS NOT NULL")


def detect_semantic_issues(df: DataFrame) -> DataFrame:
    v = F.col("value")
    flags = {"present": v.isNotNull(), "null_strings": C.is_null_token(v), "percentage_strings": strip(v).rlike(K.PERCENT),
             "boolean_strings": norm(v).isin(*K.TRUE_TOKENS, *K.FALSE_TOKENS), "negative_parentheses": strip(v).rlike(K.PAREN_NUMBER)}
    counted = count_flags(folded_text(df), flags).filter("present > 0")
    n, r = F.col("n"), F.col("n") / F.col("present")
    rules = {"null_strings": n > 0, "percentage_strings": r > 0.4, "boolean_strings": r > 0.7,
             "negative_parentheses": (n >= 2) & (r > 0.05)}
    long = counted.unpivot(["column_name", "present"], list(rules), "issue", "n")
    open_rule = F.lit(False)
    for name, rule in rules.items():
        open_rule = open_rule | ((F.col("issue") == name) & rule)
    return long.filter(open_rule).select("column_name", "issue", F.col("n").alias("count"), F.round(r, 2).alias("ratio"))


def drop_empty_reference_columns(df: DataFrame) -> tuple[DataFrame, list[dict]]:
    named = [c for c in df.columns if c.strip().lower() in K.EMPTY_REFERENCE_NAMES]
    if not named:
        return df, []
    row = df.agg(*[F.count_if(strip(col(c).cast("string")) != "").alias(f"n{i}") for i, c in enumerate(named)]).first()
    empty = [c for i, c in enumerate(named) if not row[f"n{i}"]]
    audit = [{"step": i, "action": "DROP_EMPTY_REFERENCE_COLUMN", "column_name": c, "rows_affected": 0, "confidence": 90,
              "source": "deterministic"} for i, c in enumerate(empty)]
    return df.drop(*empty), audit


# --------------------------------------------------------------------------- categories

MERGE_SCHEMA = "column_name string, old_value string, new_value string, n long, confidence double, type string"


def _keyed(values: DataFrame) -> DataFrame:
    """(column_name, value, n, key, form) of values with how often they come; key and form are short stand-ins."""
    v = F.col("value")
    return values.select("column_name", "value", "n", value_key(v).alias("key"), value_key(norm(v)).alias("form"))


def _present(df: DataFrame) -> DataFrame:
    """(column_name, value, n) of the text values present, a row each."""
    return long_text(df).filter(F.col("value").isNotNull()).select("column_name", "value", F.lit(1).cast("long").alias("n"))


def counted_values(df: DataFrame) -> DataFrame:
    """(column_name, value, n): the distinct text values with how often they come, counted in one pass over the table and stored."""
    return cut_lineage(_present(df).groupBy("column_name", "value").agg(F.sum("n").alias("n")))


def _families(values: DataFrame) -> DataFrame:
    """(column_name, value, form, n) of the values among ``values`` (column_name, value, n) that are spelled in more than one way."""
    keyed = _keyed(values)
    several = (keyed.groupBy("column_name", "form", "key").agg(F.count("*").alias("rows")).groupBy("column_name", "form").agg(F.count("*").alias("spellings"))
               .filter("spellings > 1").select("column_name", "form"))
    return keyed.join(several, ["column_name", "form"], "left_semi").groupBy("column_name", "form", "value").agg(F.sum("n").alias("n"))


def case_families(df: DataFrame) -> DataFrame:
    """(column_name, value, form, n) of the values that are spelled in more than one way.

    Spellings are counted by key, so long texts stay where they are; only the texts of families with several spellings are read again.
    """
    return _families(_present(df))


def case_variant_merges(df: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Spellings that differ only in case or edge space, with the most frequent as canonical. Columns of any width are looked at.

    ``values`` are the ``counted_values`` of the table, where they are known.
    """
    family = Window.partitionBy("column_name", "form")
    ranked = (case_families(df) if values is None else _families(values)).withColumn("new_value", F.first("value").over(family.orderBy(F.desc("n"), "value")))
    return ranked.filter("value <> new_value").select(
        "column_name", F.col("value").alias("old_value"), "new_value", "n", F.lit(0.95).alias("confidence"), F.lit("case_variant").alias("type"))


def plain_form(x: Column) -> Column:
    """Lower-cased text without one leading title or article and one company suffix."""
    prefixes = "|".join(re.escape(p).replace(r"\ ", " ") for p in K.NOISE_PREFIXES)
    suffixes = "|".join(re.escape(s).replace(r"\ ", " ") for s in sorted(K.NOISE_SUFFIXES, key=len, reverse=True))
    bare = F.regexp_replace(norm(x), f"^({prefixes})", "")
    return strip(F.regexp_replace(bare, f"({suffixes})$", ""))


def fuzzy_merges(df: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Likely typos and word-order variants among the values that case merging leaves, whatever their number and length.

    All pairs of a column that are alike are found (``spelling``). Values whose digits differ are different things. Of a pair the more
    frequent value wins; a variant goes to its closest winner, and no winner is itself a variant. ``values`` as in ``case_variant_merges``.
    """
    counts = counted_values(df) if values is None else values
    left = counts.join(case_variant_merges(df, counts).select("column_name", F.col("old_value").alias("value")), ["column_name", "value"], "left_anti")
    form = plain_form(F.col("value"))
    values = cut_lineage(left.select(
        F.monotonically_increasing_id().alias("id"), "column_name", "value", "n", norm(F.col("value")).alias("low"), form.alias("form"),
        F.array_join(F.array_sort(F.split(form, r"\s+")), " ").alias("sorted"), F.xxhash64("column_name", F.regexp_replace("value", "[^0-9]", "")).alias("scope")))
    side = lambda k: values.select(F.col("id").alias(k), F.struct("column_name", "value", "n", "low", "form", "sorted", F.regexp_replace("value", "[^0-9]", "").alias("digits")).alias(f"v{k}")).hint("merge")
    met = spelling.candidate_pairs(values).join(side("a"), "a").join(side("b"), "b").select(F.col("va").alias("x"), F.col("vb").alias("y"))
    same = (F.col("x.column_name") == F.col("y.column_name")) & (F.col("x.digits") == F.col("y.digits")) & (F.col("x.low") != F.col("y.low"))
    wins = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.value") < F.col("y.value")))
    met = met.filter(same).select(F.when(wins, F.col("x")).otherwise(F.col("y")).alias("w"), F.when(wins, F.col("y")).otherwise(F.col("x")).alias("o"))
    pairs = met.select(
        "o.column_name", F.col("o.value").alias("old_value"), F.col("w.value").alias("new_value"), F.col("w.n").alias("winner_n"), "o.n",
        F.col("w.form").alias("a"), F.col("o.form").alias("b"), F.col("w.sorted").alias("sa"), F.col("o.sorted").alias("sb"))
    far = F.levenshtein("a", "b", spelling.EDITS) < 0
    close = spelling.with_likeness(pairs).filter((F.col("ratio") >= spelling.LIKE) & ~(far & (F.col("ratio") < spelling.VERY_LIKE)))
    best = Window.partitionBy("column_name", "old_value").orderBy(F.desc("ratio"), F.desc("winner_n"), "new_value")
    chosen = cut_lineage(close.withColumn("rank", F.row_number().over(best)).filter("rank = 1").drop("a", "b", "sa", "sb"))
    variants = chosen.select("column_name", F.col("old_value").alias("new_value"))
    return chosen.join(variants, ["column_name", "new_value"], "left_anti").select(
        "column_name", "old_value", "new_value", "n", F.round("ratio", 2).alias("confidence"), F.lit("fuzzy_merge").alias("type"))


def category_merges(df: DataFrame, fuzzy: bool = True) -> DataFrame:
    if not fuzzy:
        return case_variant_merges(df)
    values = counted_values(df)  # both kinds of merges read the values, not the table
    return case_variant_merges(df, values).unionByName(fuzzy_merges(df, values))


MAPPED_BYTES = 4 << 20  # largest mapping that is broadcast


def apply_corrections(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Exact-value replacement from (column_name, old_value, new_value) rows, all columns in one pass.

    A mapping measured to be at most ``MAPPED_BYTES`` is broadcast and looked up column by column in one stage. Beyond that the table gets stored row
    numbers, its cells to correct meet their corrections by (column, value), and what changes comes back as one row per changed row.
    Of several new values for one old value the smallest is used; ``correction_conflicts`` lists them.
    """
    text = {c: df.schema[c].dataType.simpleString() for c in df.columns}
    wanted = corrections.filter(F.col("column_name").isin(*df.columns) & F.col("old_value").isNotNull() & F.col("new_value").isNotNull())
    mapping = wanted.groupBy("column_name", "old_value").agg(F.min("new_value").alias("new_value"))
    facts = mapping.agg(F.coalesce(F.sum(F.octet_length("old_value") + F.octet_length("new_value") + F.lit(64)), F.lit(0)).alias("bytes"), F.collect_set("column_name").alias("columns")).first()
    named = [c for c in df.columns if c in facts.columns]
    if not named:
        return df

    def corrected(new: Column, c: str) -> Column:
        return F.coalesce(new if text[c] == "string" else new.try_cast(text[c]), col(c)).alias(c)

    if facts.bytes <= MAPPED_BYTES:
        rows: dict[str, list] = {c: [] for c in named}
        for r in mapping.collect():
            rows[r.column_name].append((r.old_value, r.new_value))
        out = df
        for i, c in enumerate(named):  # hash lookups of one stage, nothing is shuffled
            small = F.broadcast(df.sparkSession.createDataFrame(rows[c], f"__old{i} string, __new{i} string"))
            out = out.join(small, col(c).cast("string") == F.col(f"__old{i}"), "left")
        return out.select(*[corrected(F.col(f"__new{named.index(c)}"), c) if c in named else col(c) for c in df.columns])
    numbered = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("old_value")) for c in named]))
    changed = numbered.select("__row", cells.alias("cell")).select("__row", "cell.*").join(mapping, ["column_name", "old_value"])
    changed = changed.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "new_value"))).alias("__new"))
    joined = numbered.join(changed, "__row", "left")
    return joined.select(*[corrected(F.try_element_at("__new", F.lit(c)), c) if c in named else col(c) for c in df.columns])


def correction_conflicts(corrections: DataFrame) -> DataFrame:
    """Old values that were given more than one new value, with all of them."""
    return (corrections.groupBy("column_name", "old_value").agg(F.array_sort(F.collect_set("new_value")).alias("new_values"))
            .filter(F.size("new_values") > 1))


def correction_counts(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Rows each correction touches."""
    wanted = [r.column_name for r in corrections.select("column_name").distinct().collect()]
    wanted = [c for c in df.columns if c in wanted]
    cast = df.select(*[col(c).cast("string").alias(c) for c in wanted])
    counts = long_text(cast, wanted).groupBy("column_name", F.col("value").alias("old_value")).agg(F.count("*").alias("rows_affected"))
    return corrections.join(counts, ["column_name", "old_value"]).select("column_name", "old_value", "new_value", "rows_affected")


def merge_categories(df: DataFrame, threshold: float = 0.90, fuzzy: bool = True) -> tuple[DataFrame, list[dict]]:
    """Apply the merges that are sure enough. They stay a stored table; the audit has one row per column and kind of merge."""
    sure = cut_lineage(category_merges(df, fuzzy).filter(F.col("confidence") >= threshold))
    told = sure.groupBy("column_name", "type").agg(F.sum("n").alias("n"), F.count("*").alias("merges"), F.min("confidence").alias("least")).collect()
    order = {c: i for i, c in enumerate(df.columns)}
    audit = [{"step": i, "action": "MERGE_CATEGORY", "column_name": r.column_name, "rows_affected": r.n, "confidence": int(round(r.least * 100)),
              "source": "deterministic", "detail": f"{r.merges} values merged, {r.type}"} for i, r in enumerate(sorted(told, key=lambda r: (order[r.column_name], r.type)))]
    return (apply_corrections(df, sure), audit) if told else (df, [])


def value_frequency_sample(df: DataFrame, head: int = 15, tail: int = 15) -> DataFrame:
    """The most and the least frequent values of each text column."""
    v = F.col("value")
    counts = long_text(df).filter(v.isNotNull()).groupBy("column_name", value_key(v).alias("value")).agg(F.count("*").alias("n"))
    top = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    low = Window.partitionBy("column_name").orderBy(F.asc("n"), F.desc("value"))
    first = counts.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= head).select("column_name", "value", "n")
    last = counts.withColumn("rank", F.row_number().over(low)).filter(F.col("rank") <= tail).select("column_name", "value", "n")
    return first.union(last).distinct()


def value_frequency_draw(df: DataFrame, head: int = 10, tail: int = 5, seed: int = 0) -> DataFrame:
    """The most frequent values of each text column and a seeded draw of the others: those with the smallest digest of seed and value."""
    v = F.col("value")
    counts = long_text(df).filter(v.isNotNull()).groupBy("column_name", value_key(v).alias("value")).agg(F.count("*").alias("n"))
    top = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    first = counts.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= head).select("column_name", "value", "n", F.lit("head").alias("part"))
    rest = counts.join(first.select("column_name", "value"), ["column_name", "value"], "left_anti")
    drawn = Window.partitionBy("column_name").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), v)))
    return first.union(rest.withColumn("rank", F.row_number().over(drawn)).filter(F.col("rank") <= tail).select("column_name", "value", "n", F.lit("draw")))


def analyze(df: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Everything that could be corrected, as (column_name, area, issue, count) rows."""
    encoding = detect_encoding(df).groupBy("column_name").agg(F.sum("occurrences").alias("count")).select(
        "column_name", F.lit("encoding").alias("area"), F.lit("broken_sequences").alias("issue"), "count")
    formats = detect_format_mix(df).select("column_name", F.lit("format").alias("area"), "issue", F.lit(1).cast("long").alias("count"))
    types = detect_type_issues(df).select("column_name", F.lit("type").alias("area"), "issue", F.lit(1).cast("long").alias("count"))
    semantic = detect_semantic_issues(df).select("column_name", F.lit("semantic").alias("area"), "issue", "count")
    merges = category_merges(df, fuzzy).groupBy("column_name", "type").agg(F.count("*").alias("count")).select(
        "column_name", F.lit("category").alias("area"), F.col("type").alias("issue"), "count")
    return encoding.unionByName(formats).unionByName(types).unionByName(semantic).unionByName(merges)
