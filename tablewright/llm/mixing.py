"""Mixing sources to target weights, in DataFrame operations alone.

A source's target is its share, by weight, of all words, but at most ``most`` times its own words; what is above is shared again by
weight. With the sources sorted by (most * words / weight), the sources that stop are the first ones, and the level at which the
others share is the largest of (rest of the words) / (rest of the weights) over the sorted list, so one window over the sources finds it.

Every text gets a hash-random key (the MD5 of its id). Texts are sorted by key within ranges of keys, a range holding a few
thousand texts whatever the size of the source; word counts are summed per range, running sums over ranges and
inside ranges add to each text's distance from the start of its source. A source is taken whole as many times as fits, and once
more up to the word where its budget ends, so the text on the edge is taken in part.

Defined cases: null texts have no words; null sources are one source, sorted last; a null id has the key of an empty text. Rows of
the same id and text are taken one after the other. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import stored

WORD = "[^\\x20\\x09-\\x0D]+"
MOST = 3
RANGE_ROWS = 4096
SPACE_LIMIT = "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, digest, size in words) of every text, stored: the text is read once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD))
    return stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("digest"), size.cast("long").alias("size")), "sizes")


def targets(sized: DataFrame, weights: int = 3, most: int = MOST) -> DataFrame:
    """(source, source_size, target): sources in code point order, nulls last, weigh 1 .. ``weights``, again and again."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % weights + 1)
    rising = Window.orderBy((most * F.col("source_size")) / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.select(
        "*", (F.sum("source_size").over(everything) - F.sum(most * F.col("source_size")).over(rising) + most * F.col("source_size")).alias("rest"),
        (F.sum("weight").over(everything) - F.sum("weight").over(rising) + F.col("weight")).alias("rest_weight"))
    level = level.withColumn("level", F.max(F.col("rest").cast("double") / F.col("rest_weight")).over(everything))
    return level.select("source", "source_size", F.least((most * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mixed_rows(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """``sized`` with source_size, target and ``taken``, the words the mix takes of the text (repeats counted)."""
    digits = max(0, math.ceil(math.log(max(1, sized.count()) / RANGE_ROWS, 16)))
    keyed = sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("part", F.substring("key", 1, digits))
    keyed = keyed.withColumn("source_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    goals = goals.withColumn("source_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    before = Window.partitionBy("source_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keyed.groupBy("source_id", "part").agg(F.sum("size").alias("words")).withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    parts = parts.join(goals, "source_id").select("source_id", "part", "offset", "source_size", "target")
    inner = Window.partitionBy("source_id", "part").orderBy("key", "size", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = keyed.join(parts, ["source_id", "part"]).withColumn("before", F.col("offset") + F.sum("size").over(inner) - F.col("size"))
    rows = rows.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    rest = F.floor(F.col("target") - F.col("rounds") * F.col("source_size"))
    more = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return rows.select("doc_id", "source", "digest", "size", "source_size", "target", (F.col("rounds") * F.col("size") + more).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Row per text: doc_id, source, digest, size, source_size, target, taken."""
    sized = sizes(docs, id_col, text_col, source_col)
    return mixed_rows(sized, targets(sized))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: rows of ``docs``, once per time a text is taken, the one on the edge cut after its last word taken."""
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"  # names that no column has
    i, d, s, t, z, r, x = (mark + n for n in ("id", "digest", "source", "taken", "size", "round", "cut"))
    taken = mix(docs, id_col, text_col, source_col)
    key = ["doc_id", "digest", "source"]
    repeated = not taken.groupBy(*key).count().where("count > 1").isEmpty()
    took = taken.where("taken > 0").groupBy(*key).agg(F.sum("taken").alias(t), F.first("size").alias(z))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # texts meet their decision by id, digest and source; what may be null is joined as text
    named = lambda c, n: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")).alias(n)
    own = docs.select(named(F.col(id_col), i), F.xxhash64(text).alias(d), named(F.col(source_col), s), *[F.col(f"`{c}`") for c in docs.columns])
    took = took.select(named(F.col("doc_id"), i), F.col("digest").alias(d), named(F.col("source"), s), t, z)
    rows = own.join(took, [i, d, s])
    if repeated:  # rows of one id, text and source stand for one, which is taken as often as all of them: the first by the hash of its columns
        plain = [F.col(f"`{c}`").cast("string") for c in docs.columns]
        first = Window.partitionBy(i, d, s).orderBy(F.xxhash64(*plain), F.to_json(F.array(*plain)))
        rows = rows.withColumn(r, F.row_number().over(first)).where(F.col(r) == 1).drop(r)
    rows = rows.withColumn(r, F.explode(F.sequence(F.lit(1), F.ceil(F.col(t) / F.col(z)).cast("int"))))
    left = F.col(t) - (F.col(r) - 1) * F.col(z)
    cut = F.when(left >= F.col(z), text).otherwise(F.concat_ws("", F.slice(F.split(text, SPACE_LIMIT), F.lit(1), left.cast("int"))))
    rows = rows.withColumn(x, cut)
    kinds = dict(docs.dtypes)
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col(x).alias(c))
        elif c == "n_chars":
            out.append(F.length(x).cast(kinds[c]).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return rows.select(*out)
