"""Rules of the knowledge catalogue: encodings, scalings, extra checks and retail measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import constants as K
from tablewright.functions.quantiles import exact_quantiles
from tablewright.functions.segments import cumulative, haloed
from tablewright.functions.text import clean_space, col, norm, words
from tablewright.operators import profile as P
from tablewright.operators import spelling
from tablewright.session import cut_lineage

# --------------------------------------------------------------------------- outliers


def zscore_outliers(df: DataFrame, value: str, id: str, limit: float = 3.0) -> DataFrame:
    s = P.measure_numbers(df, [value], quantiles=False)[value]
    z = F.try_divide(P.as_double(df, value) - F.lit(s.get("mean")), F.lit(s.get("std")).cast("double"))
    return df.select(col(id), P.as_double(df, value).alias("value"), F.round(z, 4).alias("z")).filter(F.abs("z") > limit)


def mad_outliers(df: DataFrame, value: str, id: str, limit: float = 3.5) -> DataFrame:
    """Modified z-score from the median and the median absolute deviation, both exact."""
    s = P.measure_numbers(df, [value])[value]
    away = df.select(F.abs(P.as_double(df, value) - F.lit(s["median"])).alias("away"))
    mad = exact_quantiles(away, ["away"], [0.5])["away"][0]
    score = F.try_divide(F.lit(0.6745) * (P.as_double(df, value) - F.lit(s["median"])), F.lit(mad))
    return df.select(col(id), P.as_double(df, value).alias("value"), F.round(score, 4).alias("score")).filter(F.abs("score") > limit)


def rolling_median(df: DataFrame, value: str, order: str, tie: str, keys: list[str], reach: int = 2, segments: int | None = None) -> DataFrame:
    """Median of each value with its ``reach`` neighbours on either side, per key."""
    rows = haloed(df.select(*[col(k) for k in keys], col(order), col(tie), P.as_double(df, value).alias("v")), keys, order, tie, reach, segments)
    frame = Window.partitionBy(*[col(k) for k in keys], "__segment").orderBy(col(order), col(tie)).rowsBetween(-reach, reach)
    near = F.sort_array(F.filter(F.collect_list("v").over(frame), lambda x: x.isNotNull()))
    n = F.size("near")
    low, high = F.get("near", F.floor((n - 1) / 2).cast("int")), F.get("near", F.floor(n / 2).cast("int"))
    return rows.withColumn("near", near).filter("__own").select(
        *[col(k) for k in keys], col(order), col(tie), "v", ((low + high) / 2).alias("smoothed"))


def impossible_values(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows breaking each named rule, all counted in one aggregate."""
    counted = df.agg(F.count("*").alias("rows"), *[F.count_if(F.expr(e)).alias(n) for n, e in rules.items()])
    return counted.unpivot(["rows"], list(rules), "rule", "violations").select("rule", "violations", P.share(F.col("violations"), F.col("rows"), 4).alias("pct"))


# --------------------------------------------------------------------------- encodings, scalings, features


def frequency_encoding(df: DataFrame, name: str) -> DataFrame:
    """Each value's count, joined from a grouped count so that a hot value is not windowed in one task."""
    counts = df.groupBy(col(name).alias("__value")).agg(F.count("*").alias(f"{name}_frequency"))
    return df.join(counts, col(name).eqNullSafe(F.col("__value")), "left").drop("__value")


def ordinal_encoding(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    ranks = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i + 1)])
    return df.withColumn(f"{name}_rank", ranks[col(name)])


def target_encoding(df: DataFrame, name: str, target: str, smoothing: float = 20.0) -> DataFrame:
    """Category mean pulled towards the overall mean when the category is rare; null where no row has a target."""
    y = P.as_double(df, target)
    overall = F.lit(df.agg(F.avg(y).alias("m")).first().m).cast("double")
    means = df.groupBy(col(name).alias("__value")).agg(((F.sum(y) + smoothing * overall) / (F.count(y) + smoothing)).alias(f"{name}_target"))
    return df.join(means, col(name).eqNullSafe(F.col("__value")), "left").drop("__value")


def minmax_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    ends = P.long_numbers(df, columns).groupBy("column_name").agg(F.min("value").alias("a"), F.max("value").alias("b")).collect()
    by = {r.column_name: r for r in ends}
    return df.withColumns({f"{c}_scaled": F.try_divide(P.as_double(df, c) - F.lit(by[c].a), F.lit(by[c].b - by[c].a)) for c in columns if c in by and by[c].a is not None})


def log1p_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_log": F.log1p(P.as_double(df, c)) for c in columns})


def duration_features(df: DataFrame, start: str, end: str) -> DataFrame:
    micros = F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))
    return df.withColumn("duration_days", F.floor(micros / 86_400_000_000)).withColumn("duration_hours", F.floor(micros / 3_600_000_000))


def text_length(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("text_length", F.length(col(name)).cast("long")).withColumn("word_count", F.size(words(col(name))).cast("long"))


def group_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    y = P.as_double(df, value)
    stats = df.groupBy(col(key).alias("__key")).agg(F.avg(y).alias("group_mean"), F.count(y).alias("group_count"), F.stddev_samp(y).alias("group_std"))
    return df.join(stats, col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


# --------------------------------------------------------------------------- suspicious columns and labels


def suspicious_columns(df: DataFrame, p: P.TableProfile, order: str | None = None) -> DataFrame:
    """Constant, nearly constant, all-unique, delimiter-packed and index-like columns."""
    c = F.col
    base = p.frame()
    out = base.filter("distinct = 1").select("column_name", F.lit("constant").alias("issue"))
    out = out.unionByName(base.filter("distinct > 1 AND mode_count > 0.98 * rows").select("column_name", F.lit("near_constant").alias("issue")))
    named = F.exists(F.array(*[F.lit(w) for w in K.IDENTIFIER_NAMES]), lambda w: F.lower("column_name").contains(w))
    out = out.unionByName(base.filter("kind = 'text' AND distinct = rows").filter(~named).select("column_name", F.lit("all_unique").alias("issue")))
    text = P.text_columns(df)
    if text:
        packed = P.count_flags(P.folded_text(df, text), {"present": c("value").isNotNull(), "packed": c("value").rlike(r"[,|;]")})
        out = out.unionByName(packed.filter("packed > 0.2 * present").select("column_name", F.lit("delimiter_packed").alias("issue")))
    if order:
        others = [n for n in P.numeric_columns(df) if n != order]
        r = P.correlations(df.select(col(order), *[col(n) for n in others]), against=order)
        out = out.unionByName(r.filter(F.abs("r") > 0.95).select(c("col2").alias("column_name"), F.lit("index_correlated").alias("issue")))
    return out


def class_imbalance(df: DataFrame, label: str) -> DataFrame:
    counts = df.filter(col(label).isNotNull()).groupBy(col(label).alias("label")).agg(F.count("*").alias("n"))
    pct = 100.0 * F.col("minority") / F.col("rows")
    return counts.agg(F.count("*").alias("classes"), F.min("n").alias("minority"), F.sum("n").alias("rows")).select(
        F.lit(label).alias("column_name"), "classes", "minority", F.round(pct, 2).alias("minority_pct"),
        F.when(pct < 5, "critical").when(pct < 15, "warning").when(pct < 20, "low").otherwise("none").alias("severity"))


def target_leakage(df: DataFrame, target: str, limit: float = 0.95) -> DataFrame:
    """Features whose correlation with the target is too good."""
    r = P.correlations(df, against=target).filter(F.abs("r") > limit)
    return r.select(F.when(F.col("col1") == target, F.col("col2")).otherwise(F.col("col1")).alias("column_name"), F.round("r", 3).alias("correlation"))


def key_conflicts(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Keys that appear with different attributes. Copies are folded before the keys meet."""
    variants = df.select(col(key).alias("key"), *[col(a) for a in attributes]).distinct()
    return variants.groupBy("key").agg(F.count("*").alias("variants")).filter("variants > 1")


def broken_measure(df: DataFrame, name: str) -> DataFrame:
    x = P.as_double(df, name)
    return df.agg(F.count_if(x == 0).alias("zeros"), F.count_if(x < 0).alias("negatives"), F.count_if(x.isNull()).alias("nulls"), F.count("*").alias("rows"))


def date_gaps(df: DataFrame, name: str, least_days: int = 2) -> DataFrame:
    """Stretches without any row, from the distinct days. A table has few days, whatever its size."""
    days = df.select(F.to_date(col(name).cast("timestamp")).alias("day"), F.lit(1).alias("all")).filter("day IS NOT NULL").distinct()
    step = Window.partitionBy("all").orderBy("day")
    gaps = days.withColumn("previous", F.lag("day").over(step)).withColumn("days", F.datediff("day", "previous"))
    return gaps.filter(F.col("days") >= least_days).select(F.col("previous").alias("from_day"), F.col("day").alias("to_day"), F.col("days").cast("long").alias("days"))


def sensitive_names(columns: DataFrame) -> DataFrame:
    low = F.lower(F.replace("column_name", F.lit(" "), F.lit("_")))
    found = F.filter(F.array(*[F.lit(w) for w in K.SENSITIVE_NAMES]), lambda w: low.contains(w))
    return columns.select("table_name", "column_name", F.explode(found).alias("pattern"))


def mixing(df: DataFrame, pattern: str) -> DataFrame:
    """Text columns that hold more than one distinct match of a pattern, such as currency or offset."""
    marks = P.long_text(df).select("column_name", F.regexp_extract("value", f"({pattern})", 1).alias("mark")).filter("mark <> ''")
    counts = marks.groupBy("column_name", "mark").agg(F.count("*").alias("n"))
    return counts.groupBy("column_name").agg(F.count("*").alias("kinds"), F.sum("n").alias("values")).filter("kinds > 1")


def currency_mixing(df: DataFrame) -> DataFrame:
    return mixing(df, K.CURRENCY)


def timezone_mixing(df: DataFrame) -> DataFrame:
    return mixing(df, r"(?:Z|[+-]\d{2}:?\d{2})$")


# --------------------------------------------------------------------------- drift


def distribution_drift(df: DataFrame, value: str, second: Column, segments: int | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and means of two parts of a table; without values on both sides no distance and no drift."""
    x = df.select(P.as_double(df, value).alias("v"), second.cast("int").alias("later")).filter("v IS NOT NULL AND later IS NOT NULL")
    counts = x.groupBy("v").agg(F.sum(1 - F.col("later")).alias("a"), F.sum("later").alias("b"))
    sums = x.agg(F.sum(1 - F.col("later")).alias("n_before"), F.sum("later").alias("n_after"),
                 F.avg(F.when(F.col("later") == 0, F.col("v"))).alias("mean_before"), F.avg(F.when(F.col("later") == 1, F.col("v"))).alias("mean_after")).first()
    n, m = sums.n_before or 0, sums.n_after or 0
    gap = F.abs(F.try_divide("upto_a", F.lit(n)) - F.try_divide("upto_b", F.lit(m)))
    reach = 1.358 * ((n + m) / (n * m)) ** 0.5 if n and m else float("inf")  # 5 % level
    return cumulative(counts, "v", ["a", "b"], segments).agg(F.max(gap).alias("ks")).select(
        F.lit(value).alias("column_name"), F.round("ks", 6).alias("ks_distance"), F.round(F.lit(sums.mean_before).cast("double"), 4).alias("mean_before"),
        F.round(F.lit(sums.mean_after).cast("double"), 4).alias("mean_after"), F.coalesce(F.col("ks") > reach, F.lit(False)).alias("drifted"))


def schema_frame(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column_name string, type string")


def schema_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """New, missing and retyped columns of a table against the expected schema."""
    a = schema_frame(expected).withColumnRenamed("type", "expected_type")
    joined = a.join(schema_frame(actual).withColumnRenamed("type", "actual_type"), "column_name", "full_outer")
    change = F.when(F.col("actual_type").isNull(), "missing").when(F.col("expected_type").isNull(), "new").when(F.col("expected_type") != F.col("actual_type"), "retyped")
    return joined.select("column_name", "expected_type", "actual_type", change.alias("change")).filter("change IS NOT NULL")


# --------------------------------------------------------------------------- privacy, integrity


CARD = r"\b\d(?:[ -]*\d){12,15}\b"  # the card pattern from its first to its last digit


def luhn_valid(digits: Column) -> Column:
    """Checksum of a digit string."""
    reversed_digits = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    doubled = F.transform(reversed_digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mask_pii(df: DataFrame, id: str, text: str) -> DataFrame:
    """Whole texts with personal data masked: mails keep their domain, phones their last four digits,
    national ids and cards go."""
    x = col(text)
    masked = F.regexp_replace(x, r"[a-zA-Z0-9._%+-]+@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", "[email]@$1")
    masked = F.regexp_replace(masked, K.PII_PATTERNS["ssn"], "[id]")
    masked = F.regexp_replace(masked, CARD, "[card]")
    masked = F.regexp_replace(masked, r"\+?\d{1,3}[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?(\d{4})", "[phone]$1")
    return df.select(col(id), masked.alias(text), F.sha2(x, 256).alias("fingerprint"))


def card_numbers(df: DataFrame, id: str, text: str) -> DataFrame:
    """Card-like numbers in whole texts with their checksum verdict."""
    found = F.explode(F.regexp_extract_all(col(text), F.lit(f"({CARD})"), F.lit(1)))
    digits = df.select(col(id), found.alias("found")).withColumn("digits", F.regexp_replace("found", "[^0-9]", ""))
    return digits.select(col(id), "digits", luhn_valid(F.col("digits")).alias("valid"))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys without a parent, with their row counts; children fold to keys before the join."""
    keys = child.filter(col(child_key).isNotNull()).groupBy(col(child_key).alias("key")).agg(F.count("*").alias("rows"))
    return keys.join(parent.select(col(parent_key).alias("key")).distinct(), "key", "left_anti")


def rule_pass_rates(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Share of rows that satisfy each rule; a rule that is NULL for a row does not count it."""
    rated = df.agg(*[F.avg(F.expr(e).cast("double")).alias(n) for n, e in rules.items()])
    return rated.unpivot([], list(rules), "rule", "rate").select("rule", F.round(F.col("rate") * 100, 2).alias("pass_pct"))


def quality_gates(df: DataFrame, gates: dict[str, tuple[str, float | None, float | None]]) -> DataFrame:
    """Named aggregates against a lower and an upper limit, all in one pass."""
    measured = df.agg(*[F.expr(e).cast("double").alias(n) for n, (e, _, _) in gates.items()])
    cells = [F.struct(F.lit(n).alias("gate"), F.col(n).alias("value"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"))
             for n, (_, low, high) in gates.items()]
    v = F.col("value")
    passed = F.coalesce(v >= F.col("low"), F.lit(True)) & F.coalesce(v <= F.col("high"), F.lit(True)) & v.isNotNull()
    return measured.select(F.explode(F.array(*cells)).alias("g")).select("g.*").select("gate", F.round("value", 4).alias("value"), passed.alias("passed"))


# --------------------------------------------------------------------------- ranks, copies


def average_ranks(df: DataFrame, name: str, segments: int | None = None) -> DataFrame:
    """(v, rank): average rank of each distinct value."""
    counts = df.select(col(name).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    upto = cumulative(counts, "v", ["n"], segments)
    return upto.select("v", (F.col("upto_n") - (F.col("n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, a: str, b: str, segments: int | None = None) -> DataFrame:
    """Rank correlation over rows where both are present. Equal pairs are folded before the rank joins."""
    both = df.select(P.as_double(df, a).alias("a"), P.as_double(df, b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    pairs = both.groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    ranks_a = average_ranks(both, "a", segments).select(F.col("v").alias("a"), F.col("rank").alias("x"))
    ranks_b = average_ranks(both, "b", segments).select(F.col("v").alias("b"), F.col("rank").alias("y"))
    n = both.count()
    w, x, y = F.col("w"), F.col("x") - (n + 1) / 2, F.col("y") - (n + 1) / 2  # ranks always average (n + 1) / 2
    r = F.try_divide(F.sum(w * x * y), F.sqrt(F.sum(w * x * x) * F.sum(w * y * y)))
    return pairs.join(ranks_a, "a").join(ranks_b, "b").agg(F.round(r, 4).alias("spearman")).select(
        F.lit(a).alias("col1"), F.lit(b).alias("col2"), "spearman")


def typo_copies(df: DataFrame, id: str, text: str, edits: int = 3) -> DataFrame:
    """(first_id, copy_id, edits): pairs of different plain forms (case and white space aside) at most ``edits`` single-character edits apart.

    Texts of at least ``SHORTEST_COPY`` characters. Three edits leave a run of a quarter of the longer text as it was: k characters of 4 k to 4 k + 3. Winnowing
    keeps the smallest hash of every window that fits in that run, so two such texts share a kept hash of that k. They meet by it, in tiles of
    bounded size, and are compared by edit distance. Each form stands for all its copies, with the smallest of their ids.
    """
    if edits != 3:
        raise ValueError("windows are laid out for three edits")
    form = norm(clean_space(col(text)))
    forms = df.select(form.alias("form"), col(id).alias("first")).filter(F.length("form") >= SHORTEST_COPY)
    forms = forms.groupBy("form").agg(F.min("first").alias("first"))
    forms = cut_lineage(forms.withColumn("id", F.monotonically_increasing_id()))
    rows = forms.select("id", "form").mapInArrow(_kept_hashes, "key long, id long, size int, rule int, counts binary")
    met = spelling.block_pairs(rows)
    side = lambda k: forms.select(F.col("id").alias(k), F.struct("first", "form").alias(f"v{k}")).hint("merge")
    pairs = met.join(side("a"), "a").join(side("b"), "b").withColumn("edits", F.levenshtein("va.form", "vb.form", edits)).filter("edits >= 0")
    return pairs.select(F.least("va.first", "vb.first").alias("first_id"), F.greatest("va.first", "vb.first").alias("copy_id"), "edits")


SHORTEST_COPY, GRAM = 64, 6
_TURN = 0x9E3779B97F4A7C15


def _kept_hashes(batches):
    """(key, id, size, rule, counts): of each text, the smallest run hash of every window, for a quarter of its length and the next number.

    Runs are half as long as the quarter: all runs of a text at once from sums of its code points times powers of an odd number.
    """
    powers = inverse = np.ones(1, dtype=np.uint64)
    for batch in batches:
        ids, keys, sizes = batch.column(0).to_numpy(), [], []
        for text in batch.column(1).to_pylist():
            own, size = spelling.code_points([text])[0].astype(np.uint64), len(text)
            if size > len(powers):
                powers, inverse = (np.multiply.accumulate(np.append(np.uint64(1), np.full(2 * size, x, dtype=np.uint64))) for x in (_TURN, pow(_TURN, -1, 2**64)))
            upto = np.append(np.uint64(0), np.cumsum(own * powers[:size], dtype=np.uint64))
            found = []
            for quarter in (size // 4, size // 4 + 1):  # texts at most three apart in length share that of the longer
                gram = max(GRAM, quarter // 2)
                run = spelling._mixed((upto[gram:] - upto[:-gram]) * inverse[: size - gram + 1])
                found.append(spelling._mixed(np.unique(sliding_least(run, quarter - gram + 1)) ^ np.uint64(quarter)))
            key = np.unique(np.concatenate(found))
            keys.append(key)
            sizes.append(size)
        many = np.array([len(k) for k in keys], dtype=np.int64)
        n = int(many.sum())
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(ids, many)), pa.array(np.repeat(np.array(sizes, dtype=np.int32), many)),
                 pa.array(np.full(n, spelling.BY_LENGTH, dtype=np.int32)), pa.array([b""] * n, pa.binary())], ["key", "id", "size", "rule", "counts"])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours, from running minima within blocks of that width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def near_duplicates(df: DataFrame, id: str, text: str) -> DataFrame:
    """Groups of texts that differ only in case and white space, by digest of the plain form."""
    form = norm(clean_space(col(text)))
    groups = df.select(F.md5(form.cast("binary")).alias("form"), F.md5(col(text).cast("binary")).alias("exact"), col(id).alias("id"))
    folded = groups.groupBy("form", "exact").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return folded.groupBy("form").agg(F.sum("n").alias("copies"), F.count("*").alias("spellings"), F.min("id").alias("first_id")).filter("copies > 1")


# --------------------------------------------------------------------------- retail


def rfm(orders: DataFrame, customer: str, date: str, amount: str, as_of: str) -> DataFrame:
    """Recency, frequency and money per customer, scored 1 to 5 by exact fifths."""
    days = F.floor((F.lit(as_of).cast("timestamp").cast("double") - F.max(col(date).cast("timestamp")).cast("double")) / 86400)
    per = orders.groupBy(col(customer).alias("customer")).agg(
        days.cast("long").alias("recency"), F.count("*").alias("frequency"), F.round(F.sum(col(amount)), 2).alias("monetary"))
    numbers = ["recency", "frequency", "monetary"]
    cuts = exact_quantiles(P.doubles(per, numbers), numbers, [0.2, 0.4, 0.6, 0.8])

    def score(name: str) -> Column:
        passed = sum(((F.col(name) > F.lit(c)).cast("int") for c in cuts[name]), F.lit(0))
        return (5 - passed if name == "recency" else 1 + passed).alias(f"{name[0]}_score")

    return per.select("customer", *numbers, *[score(n) for n in numbers])


def customer_value(orders: DataFrame, customer: str, date: str, amount: str) -> DataFrame:
    """Average order, orders per year of custom, years of custom, and their product."""
    t = col(date).cast("timestamp").cast("double")
    per = orders.groupBy(col(customer).alias("customer")).agg(F.avg(col(amount)).alias("average"), F.count("*").alias("orders"), ((F.max(t) - F.min(t)) / 86400 / 365).alias("span"))
    years = F.greatest("span", F.lit(1.0))
    return per.select("customer", F.round("average", 6).alias("average_order"), F.round(F.col("orders") / years, 4).alias("orders_per_year"),
                      F.round(years, 4).alias("years"), F.round(F.col("average") * F.col("orders"), 2).alias("value"))


ITEM_GROUP = 256


def _pair_counts(items: int):
    """Rows (group, numbers) sorted by group: how often each item of a group meets each earlier one, a group at a time."""

    def run(batches):
        group, counts = None, None

        def sums():
            own, other = np.nonzero(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array((own + group * ITEM_GROUP).astype(np.int32)), pa.array(other.astype(np.int32)), pa.array(counts[own, other])], ["a", "b", "n"])

        for batch in batches:
            keys, lists = batch.column(0).to_numpy(), batch.column(1)
            for i, g in enumerate(keys.tolist()):
                if g != group:
                    if group is not None:
                        yield sums()
                    group, counts = g, np.zeros((ITEM_GROUP, min(items, (g + 1) * ITEM_GROUP)), dtype=np.int64)
                numbers = lists[i].values.to_numpy()
                first = int(np.searchsorted(numbers, g * ITEM_GROUP))
                for k in range(first, len(numbers)):
                    counts[numbers[k] - g * ITEM_GROUP, numbers[:k]] += 1
        if group is not None:
            yield sums()

    return run


def basket_pairs(items: DataFrame, basket: str, item: str, least_support: float = 0.01) -> DataFrame:
    """Support, confidence and lift of item pairs that occur in enough baskets, by pattern growth over groups of items.

    Items too rare for any frequent pair go first; the others are numbered, most frequent first. A basket is the rising list of its items' numbers. For
    each group of ``ITEM_GROUP`` numbers that it holds, the list up to its last item of that group is what the group's counts depend on
    (a conditional basket), so a basket is sent at most once per group and never taken apart into pairs. A task counts group against
    earlier items in an array as it reads, and gives its sums; groups are spread over tasks by a salt, so a hot one is no single task.
    """
    held = items.select(col(basket).alias("basket"), col(item).alias("item")).distinct()
    baskets = held.select("basket").distinct().count()
    counts = held.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= least_support * baskets)
    # at most (mean basket size / support) items are this frequent
    frequent = [r["item"] for r in counts.orderBy(F.desc("n"), "item").select("item").collect()]
    spark = items.sparkSession
    kind = counts.schema["item"].dataType
    numbers = spark.createDataFrame(list(zip(frequent, range(len(frequent)))), T.StructType([T.StructField("item", kind), T.StructField("number", T.IntegerType())]))
    lists = held.join(F.broadcast(numbers), "item").groupBy("basket").agg(F.sort_array(F.collect_list("number")).alias("numbers"))
    groups = F.array_distinct(F.transform("numbers", lambda n: F.floor(n / ITEM_GROUP).cast("int")))
    conditional = lists.select("basket", "numbers", F.explode(groups).alias("group")).select(
        "group", "basket", F.filter("numbers", lambda n: n < (F.col("group") + 1) * ITEM_GROUP).alias("numbers"))
    salted = conditional.repartition("group", F.pmod(F.xxhash64("basket"), F.lit(16))).sortWithinPartitions("group").select("group", "numbers")
    met = salted.mapInArrow(_pair_counts(len(frequent)), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("together")).filter(F.col("together") >= least_support * baskets)
    names = F.broadcast(numbers)
    met = met.join(names.select(F.col("number").alias("a"), F.col("item").alias("one")), "a").join(names.select(F.col("number").alias("b"), F.col("item").alias("two")), "b")
    pairs = met.select(F.least("one", "two").alias("item_a"), F.greatest("one", "two").alias("item_b"), "together")
    na, nb = counts.select(F.col("item").alias("item_a"), F.col("n").alias("na")), counts.select(F.col("item").alias("item_b"), F.col("n").alias("nb"))
    return pairs.join(na, "item_a").join(nb, "item_b").select(
        "item_a", "item_b", "together", F.round(F.col("together") / baskets, 6).alias("support"), F.round(F.col("together") / F.col("na"), 4).alias("confidence"),
        F.round(F.col("together") * F.lit(float(baskets)) / (F.col("na") * F.col("nb")), 4).alias("lift"))
