"""How far each source's words diverge from the other sources' and from its language's, by sorted pointers to word starts.

*Terms* are runs of ASCII letters and characters beyond ASCII, A-Z as a-z. A document is a row. A language keeps the terms that at
least ``least`` of its documents hold; V is their number.

*Pointers.* A task lays the texts of a slice end to end, as the Arrow buffers hold them, and keeps a pointer to the start of each word. The
pointers are sorted by multikey quicksort with characters of eight bytes: all ranges that agree so far are partitioned by their next
eight bytes, and only ranges of equal pointers whose words go on are sorted by the eight after them. Equal runs are terms; within a
run, pointers are in the order of texts, so its length is the number of occurrences, its steps from text to text the document frequency, and
both are told per source. A task adds up the runs of its slices, at most ``TERMS`` terms and ``RUNS`` runs at a time, before anything is shuffled.

*Shares.* p = 1 + floor(10^9 * (count + 1) / (N + V)), N the occurrences of kept terms in a group (language, source) or in the language.
Two shares differ by f = floor((p - q)^2 / q), q that of the other source, or of the language. All of it is integer or decimal arithmetic.

*Pairs.* The sum of f over all kept terms of two sources is that of two sources without any term, plus what the terms of one alone
change, plus a correction for the terms of both. The first two follow from each source's number of terms per count; only the last looks at terms, and tasks
add it up per pair of sources before anything is shuffled. So terms that a source lacks cost nothing.

Defined cases: null text, language and source are ''. Groups without terms are groups; with V = 0 all pair values are 0 and there are no
term rows. Rows of one id are documents of their own. A language of one source has no pairs. Extra columns are ignored; an empty table gives
an empty one. Ties of a value go by the item's UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import stored
from tablewright.llm.words import _LOWER, spans, text_slices

UNIT = 1_000_000_000
LEAST, TOP = 3, 200
TERMS, RUNS = 1 << 18, 1 << 21
PAIRS = 1 << 20
SLICE = 1 << 22
_BYTES = np.arange(256)
_KEEP = np.array([2**64 - 2 ** (64 - 8 * i) for i in range(9)], dtype=np.uint64)
NO_TERM = (_BYTES <= 0x40) | ((_BYTES >= 0x5B) & (_BYTES <= 0x60)) | ((_BYTES >= 0x7B) & (_BYTES <= 0x7F))


def _eight(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The eight bytes from each pointer on as one number that sorts like them, zero beyond the word's end. ``data`` ends in eight spare bytes."""
    there = np.ndarray(len(data) - 7, ">u8", data, 0, (1,))[first].astype(np.uint64)
    return there & _KEEP[np.minimum(last - first, 8)]


def sorted_pointers(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers in the order of their words, equal ones as they come, and where each run of equal words starts."""
    key = _eight(data, first, last)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.empty(0, dtype=bool)
    going, depth = np.flatnonzero(key & np.uint64(255)), 1  # places whose words may go on
    while len(going):
        run = np.cumsum(new)[going]
        key = _eight(data, first[order[going]] + 8 * depth, last[order[going]])
        inner = np.lexsort((key, run))  # each range by its next eight bytes
        order[going] = order[going][inner]
        run, key = run[inner], key[inner]
        new[going[1:]] |= (run[1:] == run[:-1]) & (key[1:] != key[:-1])
        going, depth = going[np.flatnonzero(key & np.uint64(255))], depth + 1
    return order, np.flatnonzero(new)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    return (keys[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values))


class _Shard:
    """Runs of a task: (group, term) with occurrences and documents."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self):
        self.terms: dict[bytes, int] = {}
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, data: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> None:
        data = np.append(_LOWER[data], np.zeros(8, dtype=np.uint8))
        first, last = spans(data[:-8], NO_TERM)
        if not len(first):
            return
        text = np.searchsorted(starts, first, "right") - 1
        order, new = sorted_pointers(data, first, last)
        raw, heads = data.tobytes(), order[new]
        numbers, known = self.terms, np.empty(len(new), dtype=np.int64)
        for i, (a, b) in enumerate(zip(first[heads].tolist(), last[heads].tolist())):
            known[i] = numbers.setdefault(raw[a:b], len(numbers))
        term = np.repeat(known, np.diff(np.append(new, len(order))))
        text = text[order]
        fresh = np.append(True, (term[1:] != term[:-1]) | (text[1:] != text[:-1]))  # the first of a term in a text
        self.runs.append(_summed(groups[text] << 32 | term, np.ones(len(term), dtype=np.int64), fresh.astype(np.int64)))
        self.held += len(self.runs[-1][0])
        if self.held > RUNS and len(self.runs) > 1:
            self.runs = [_summed(*(np.concatenate(x) for x in zip(*self.runs)))]
            self.held = len(self.runs[0][0])

    def full(self) -> bool:
        return len(self.terms) > TERMS or self.held > RUNS

    def give(self) -> Iterator[pa.RecordBatch]:
        if self.runs:
            keys, n, docs = _summed(*(np.concatenate(x) for x in zip(*self.runs)))
            names = pa.array(list(self.terms), pa.binary())
            lang, source = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
            for at in range(0, len(keys), 1 << 15):
                some = slice(at, at + (1 << 15))
                group, term = pa.array(keys[some] >> 32), pa.array(keys[some] & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([lang.take(group), source.take(group), names.take(term).cast(pa.string()), pa.array(n[some]), pa.array(docs[some])], ["lang", "source", "term", "n", "docs"])
        self.clear()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs) of one task, added up."""
    shard = _Shard()
    for batch in batches:
        own = [batch.column(i).dictionary_encode() for i in (0, 1)]
        lang, source = (c.dictionary.to_pylist() for c in own)
        both = own[0].indices.to_numpy().astype(np.int64) << 32 | own[1].indices.to_numpy()
        seen, place = np.unique(both, return_inverse=True)
        numbers = [shard.groups.setdefault((lang[x >> 32], source[x & 0xFFFFFFFF]), len(shard.groups)) for x in seen.tolist()]
        groups = np.array(numbers, dtype=np.int64)[place]
        for row, data, starts in text_slices(batch.column(2), SLICE):
            shard.add(data, starts, groups[row : row + len(starts) - 1])
            if shard.full():
                yield from shard.give()
    yield from shard.give()


def term_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, whole, head): occurrences of every kept term in every group that holds it and in its language; ``head`` marks one group per term."""
    runs = docs.select("lang", "source", "text").mapInArrow(_runs, "lang string, source string, term string, n long, docs long")
    # one shuffle serves the sums and what is told over a term's groups
    sums = runs.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    groups = Window.partitionBy("lang", "term")
    told = sums.select("*", F.sum("docs").over(groups).alias("spread"), F.sum("n").over(groups).alias("whole"), (F.min("source").over(groups) == F.col("source")).alias("head"))
    return told.where(F.col("spread") >= least).select("lang", "source", "term", "n", "whole", "head")


def _share(n: str, total: str, kept: str) -> str:
    return f"cast((cast({UNIT} as decimal(10,0)) * cast({n} + 1 as decimal(20,0))) div cast({total} + {kept} as decimal(20,0)) + 1 as long)"


def _apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, h, high, low): over the terms of one task, what pairs of groups that share a term add to their sum, in two halves of 32 bits.

    A row is the list of a term's groups, their shares of it and their shares of a term they lack.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0

    def merged():
        g, h, high, low = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((h, g))
        g, h = g[order], h[order]
        at = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])))
        return g[at], h[at], np.add.reduceat(high[order], at), np.add.reduceat(low[order], at)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["g", "h", "high", "low"])

    for batch in batches:
        group, p, zero = (batch.column(i).flatten().to_numpy() for i in range(3))
        size = np.diff(batch.column(0).offsets.to_numpy().astype(np.int64))
        first, ends = np.cumsum(size) - size, np.cumsum(size * size)
        for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            pair = np.arange(at, min(at + PAIRS, int(ends[-1])))
            term = np.searchsorted(ends, pair, "right")
            within = pair - (ends[term] - size[term] * size[term])
            i, j = first[term] + within // size[term], first[term] + within % size[term]
            i, j = i[i != j], j[i != j]
            if not len(i):
                continue
            change = _f(p[i], p[j]) - _f(p[i], zero[j]) - _f(zero[i], p[j]) + _f(zero[i], zero[j])
            names, code = np.unique(group, return_inverse=True)
            keys, high, low = _summed(code[i] * len(names) + code[j], change >> 32, change & 0xFFFFFFFF)
            parts.append((names[keys // len(names)], names[keys % len(names)], high, low))
            held += len(keys)
            if held > PAIRS:
                parts = [merged()]
                held = len(parts[0][0])
            if held > PAIRS:  # so many pairs of sources
                yield rows()
                parts, held = [], 0
    if parts:
        yield rows()


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """Row per group and other source (part ``pair``), and per group and one of its ``top`` most overused terms (part ``term``): lang, source, part, item, value, rank."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = stored(term_counts(texts, least), "term-counts")
    langs = counts.groupBy("lang").agg(F.sum("n").alias("whole_n"), F.count_if("head").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = texts.groupBy("lang", "source").agg(F.lit(True).alias("there")).drop("there").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "whole_n", "kept")])
    zero = F.when(F.col("kept") > 0, F.expr(_share("0", "total", "greatest(kept, 1)"))).otherwise(F.lit(1))  # without kept terms nothing is shared out
    groups = stored(groups.withColumn("zero", zero).withColumn("g", F.monotonically_increasing_id()), "groups")

    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "g", "zero", F.expr(_share("n", "total", "kept")).alias("p"), F.expr(_share("whole", "whole_n", "kept")).alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # what the terms of one group add to its pairs with all others: by its number of terms of each share
    steps = shares.groupBy("lang", "g", "zero", "p").agg(F.count(F.lit(1)).alias("terms"))
    other = groups.select("lang", F.col("g").alias("o"), F.col("zero").alias("lacks"))
    wide = "cast({} as decimal(20,0)) * terms"
    alone = steps.join(other, "lang").where("g <> o").select(
        "g", "o", F.expr(wide.format(f"{_apart('p', 'lacks')} - {_apart('zero', 'lacks')}")).alias("as_p"), F.expr(wide.format(f"{_apart('lacks', 'p')} - {_apart('lacks', 'zero')}")).alias("as_q"))
    alone = alone.groupBy("g", "o").agg(F.sum("as_p").alias("as_p"), F.sum("as_q").alias("as_q"))
    as_p, as_q = alone.select("g", F.col("o").alias("h"), F.col("as_p").alias("part")), alone.select(F.col("o").alias("g"), F.col("g").alias("h"), F.col("as_q").alias("part"))
    met = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "zero")).alias("x")).where("size(x) > 1").select("x.g", "x.p", "x.zero")
    both = met.mapInArrow(_corrections, "g long, h long, high long, low long")
    both = both.groupBy("g", "h").agg((F.sum("high").cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + F.sum("low").cast("decimal(20,0)")).alias("part"))
    changes = as_p.unionByName(as_q).unionByName(both).groupBy("g", "h").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    second = groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item"), F.col("zero").alias("lacks"))
    pairs = groups.join(second, "lang").where("g <> h").join(changes, ["g", "h"], "left")
    value = F.expr(f"cast(cast({_apart('zero', 'lacks')} as decimal(20,0)) * kept + coalesce(part, 0) as long)")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)


def sql(least: int = LEAST, top: int = TOP) -> str:
    """The same with every kept term in every group written out."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
w AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {least}),
langs AS (SELECT lang, sum(whole) AS n, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
filled AS (SELECT g.lang, g.source, term, coalesce(n.n, 0) AS n, whole, sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
s AS (SELECT lang, source, term, filled.n, 1 + CAST({UNIT} AS HUGEINT) * (filled.n + 1) // (total + v) AS p, 1 + CAST({UNIT} AS HUGEINT) * (whole + 1) // (langs.n + v) AS q FROM filled JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM rows) WHERE part = 'pair' OR rank <= {top}"""
