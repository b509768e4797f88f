"""Quality rules: decision lists learned from labelled text statistics.

Statistics of every text are counted once and stored. A list of rules for low quality is learned by sequential covering on a
bounded sample, the ``SAMPLE`` labelled ids with the smallest hash: two thirds of it grow a rule, adding the threshold that
gains most until no good text is covered; the other third prunes it, dropping last conditions while that raises
(bad - good) / (bad + good). A rule is kept if its precision over the sample is at least ``PRECISION``; the texts it covers go, and
the next is grown. The list becomes one ordered Spark conditional expression, so judging is a projection.

Defined cases: null and empty texts have zero counts and fail the base rules. Ratios with nothing below the line are zero. A
repeated id is judged per row; several labels of an id count as the lowest; null labels teach nothing. Without both kinds of label
the list is empty and keeps all. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import stored
from tablewright.llm.words import SPACES, slice_sequences, slice_words, span_hashes, text_slices

SAMPLE = 20000
PRECISION = 0.95
CUTS = 64
MOST_CONDITIONS = 4

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SPACE = np.isin(np.arange(256), SPACES)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_distinct", "n_adjacent"]
RATIOS = {
    "word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "n_words"), "copy_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"), "distinct_share": ("n_distinct", "n_words"), "adjacent_share": ("n_adjacent", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}


def _first_of_group(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether it is the first of its (group, value), and how often that occurs."""
    order = np.lexsort((np.arange(len(value)), value, group))
    new = np.ones(len(value), dtype=bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (value[order][1:] != value[order][:-1])
    first, times = np.empty(len(value), dtype=bool), np.empty(len(value), dtype=np.int64)
    run = np.cumsum(new) - 1
    first[order], times[order] = new, np.bincount(run, minlength=1)[run] if len(value) else 0
    return first, times


def slice_counts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts (texts x COUNTS) of a slice of texts."""
    texts = len(starts) - 1
    text, first, last, words = slice_words(data, starts, lower=False)
    per = lambda where, weight=None: np.bincount(where, weight, minlength=texts).astype(np.int64)
    total = lambda mask: np.add.reduceat(mask[data].astype(np.int64), starts[:-1])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    lined = data.copy()
    lined[starts[1:] - 1] = 10
    ends = np.flatnonzero(lined == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    filled = np.add.reduceat((~_SPACE[lined]).astype(np.int64), begins) > 0
    line_text = np.searchsorted(starts, begins, "right") - 1
    fresh, _ = _first_of_group(line_text, span_hashes(lined, begins, ends))
    at, windows = slice_sequences(text, words, 3)
    _, times = _first_of_group(text[at], windows)
    again = at[times > 1]
    covered = np.zeros(len(words) + 3, dtype=bool)
    for k in range(3):
        covered[again + k] = True
    new, _ = _first_of_group(text, words)
    beside = np.zeros(len(words), dtype=bool)
    beside[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    return np.stack([
        per(text), per(text, points[last] - points[first]), total(_SYMBOL), per(line_text, filled & ~fresh), per(text, covered[: len(words)]), per(line_text, filled),
        total(_UPPER), total(_DIGIT), per(text, new), per(text, beside),
    ], axis=1)


def _count(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        counts = np.concatenate([slice_counts(data, starts) for _, data, starts in text_slices(batch.column(1))] or [np.zeros((0, len(COUNTS)), dtype=np.int64)])
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts.T]], ["doc_id", *COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per text: doc_id, its counts and the ratios of ``RATIOS``; stored, so the texts are read once."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = stored(texts.mapInArrow(_count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)), "counts")
    return counted.select("*", *[F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).alias(r) for r, (a, b) in RATIOS.items()])


Condition = tuple[str, str, float]


def _holds(values: np.ndarray, names: list[str], rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(values), dtype=bool)
    for name, sign, cut in rule:
        v = values[:, names.index(name)]
        out &= v >= cut if sign == ">=" else v <= cut
    return out


def _best_condition(values: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, Condition] | None:
    """The threshold with the largest gain of information about the bad rows (bad rows kept x change of log precision)."""
    p, n = int(bad.sum()), int((~bad).sum())
    start, best = np.log2(p / (p + n)), None
    for k, name in enumerate(names):
        for cut in np.unique(np.quantile(values[:, k], np.linspace(0, 1, CUTS), method="nearest")):
            for sign, inside in ((">=", values[:, k] >= cut), ("<=", values[:, k] <= cut)):
                kept = int((inside & bad).sum())
                if kept == 0 or inside.all():
                    continue
                gain = kept * (np.log2(kept / int(inside.sum())) - start)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, (name, sign, float(cut)))
    return best


def learn(values: np.ndarray, bad: np.ndarray, names: list[str], precision: float = PRECISION) -> list[list[Condition]]:
    """Rules for bad rows, in order. Every third row prunes, the others grow."""
    prunes = np.arange(len(bad)) % 3 == 2
    left, rules = np.ones(len(bad), dtype=bool), []
    while (bad & left & ~prunes).any() and (~bad).any():
        rule: list[Condition] = []
        inside = left & ~prunes
        while len(rule) < MOST_CONDITIONS and (inside & ~bad).any():
            found = _best_condition(values[inside], bad[inside], names)
            if found is None:
                break
            rule.append(found[1])
            inside = left & ~prunes & _holds(values, names, rule)
        worth = []
        for k in range(1, len(rule) + 1):
            hit = left & prunes & _holds(values, names, rule[:k])
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            worth.append((p - n) / (p + n) if p + n else -1.0)
        rule = rule[: int(np.argmax(worth)) + 1] if worth else rule
        hit = left & _holds(values, names, rule)
        if not rule or (hit & bad).sum() < precision * hit.sum() or (hit & bad).sum() < 2:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learned_rules(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> list[list[Condition]]:
    """Rules from the labelled rows of ``stats`` (see the module's text)."""
    names = [*COUNTS, *RATIOS]
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    chosen = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = stats.join(chosen, "doc_id").select("doc_id", "label", *names).orderBy(F.xxhash64("doc_id"), *names).limit(2 * sample).toPandas()
    return learn(rows[names].to_numpy(dtype=float), (rows["label"] == 0).to_numpy(), names) if len(rows) else []


def expression(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional expression: false where a rule holds, true where none does."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for name, sign, cut in rule:
            test = test & (F.col(name) >= F.lit(cut) if sign == ">=" else F.col(name) <= F.lit(cut))
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Row per text: its counts, ``base_failed`` (too short or too repetitive) and ``kept`` (neither that nor a learned rule)."""
    stats = statistics(docs, id_col, text_col)
    rules = learned_rules(stats, labels, "doc_id", label_col)
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & expression(rules))
