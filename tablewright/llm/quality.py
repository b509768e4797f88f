"""Quality of whole texts from a linear-chain conditional random field over their lines.

Every line of a text (split at \\n) is good or bad. The field scores a line by binned statistics of the line and of its neighbours,
and a pair of lines by a transition weight. Forward-backward gives each line's chance to be good; a text's score is
their mean, weighted by line length, put on the scale of label frequencies by a logistic curve.

The field is fitted on a bounded sample: the ``SAMPLE`` labelled texts with the smallest hash of their id. A
text's label holds for all its lines. For fitting only, texts are cut into chains of ``CHAIN`` lines; scoring runs over whole texts.
The sample's line statistics are the only thing that reaches the driver; every text is scored where it is read, without a shuffle.

Defined cases: null and empty texts are one empty line and get a score like any other. A repeated id is scored per row; with
several labels for an id the lowest counts; null labels and null ids teach nothing. Without both kinds of label every score is
the share of good labels (0.5 without labels). Extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.words import slice_words, span_hashes, text_slices

SAMPLE = 4000
CHAIN = 64
BINS = 6
STEPS = 120
NAMES = ["chars", "words", "letters", "upper", "digits", "symbols", "marks", "word_length", "long_words", "repeats", "new_words", "copy", "ends"]
NEAR = [3, 5, 7, 9, 10, 11]  # those that also count when the line before or after has them

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[192:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>@^~_=+{}[]\\"))
_MARK = np.isin(np.arange(256), list(b".,;:!?'\"()-"))
_FULL_STOP = np.isin(np.arange(256), list(b".!?:"))


def _new(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether an entry is the first of its group with its value."""
    order = np.lexsort((np.arange(len(value)), value, group))
    first = np.ones(len(value), dtype=bool)
    first[order[1:]] = (group[order][1:] != group[order][:-1]) | (value[order][1:] != value[order][:-1])
    return first


def line_statistics(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (lines x NAMES), text number and length in characters of every line of a slice of texts."""
    data = data.copy()
    data[starts[1:] - 1] = 10
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    text = np.searchsorted(starts, begins, "right") - 1
    total = lambda mask: np.add.reduceat(mask[data].astype(np.int32), begins)
    chars = np.add.reduceat(((data & 0xC0) != 0x80).astype(np.int32), begins) - 1
    owner, first, last, words = slice_words(data, starts, lower=False)
    line = np.searchsorted(begins, first, "right") - 1
    n = len(begins)
    count = np.bincount(line, minlength=n)
    some, each = np.maximum(chars, 1), np.maximum(count, 1)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    copy = ~_new(text, span_hashes(data, begins, ends)) & (count > 0)
    before = np.maximum(ends - 1, 0)
    stats = np.stack([
        np.log1p(chars), np.log1p(count), total(_LETTER) / some, total(_UPPER) / some, total(_DIGIT) / some, total(_SYMBOL) / some, total(_MARK) / some,
        np.bincount(line, last - first, minlength=n) / each, np.bincount(line, (last - first) > 20, minlength=n) / each,
        np.bincount(line, again, minlength=n) / each, np.bincount(line, _new(owner, words), minlength=n) / each, copy,
        (ends > begins) & _FULL_STOP[data[before]],
    ], axis=1).astype(np.float32)
    return stats, text, chars + 1


@dataclasses.dataclass
class Field:
    """Bin edges (statistics x edges), weights of line features, transition weights, and the curve from mean chance to score."""

    edges: np.ndarray
    weights: np.ndarray
    pair: np.ndarray
    curve: tuple[float, float]
    constant: float | None = None


def _features(edges: np.ndarray, stats: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Numbers of the features that hold for each line: one bin per statistic, per neighbour's statistic, and the ends of a text."""
    bins = np.stack([np.searchsorted(e, s, "right") for e, s in zip(edges, stats.T)], axis=1)
    width, k = edges.shape[1] + 1, bins.shape[1]
    out = [bins + np.arange(k) * width]
    base = k * width
    for step in (1, -1):
        near = np.roll(bins[:, NEAR], step, axis=0)
        same = np.roll(text, step) == text
        if step == 1:
            same[:1] = False
        else:
            same[-1:] = False
        near = np.where(same[:, None], near + 1, 0)
        out.append(base + near + np.arange(len(NEAR)) * (width + 1))
        base += len(NEAR) * (width + 1)
    return np.concatenate(out, axis=1)


def _size(edges: np.ndarray) -> int:
    width = edges.shape[1] + 1
    return edges.shape[0] * width + 2 * len(NEAR) * (width + 1)


def _chances(score: np.ndarray, chain: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Chance of "good" per line, expected transitions (2 x 2) per chain weight, and the log of the chains' partition sums.

    ``score`` is the log odds that a line brings by itself. Chains are runs of equal ``chain``; all advance together, one line a step.
    """
    first = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    length = np.diff(np.append(first, len(chain)))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    own = np.stack([np.zeros_like(score), score], axis=1)
    fore, back = np.zeros_like(own), np.zeros_like(own)
    fore[first] = own[first]
    active = [int(x) for x in np.searchsorted(-length, -np.arange(1, length.max() + 1), "right")]
    for t in range(1, length.max()):
        at = first[: active[t]] + t
        fore[at] = own[at] + np.logaddexp(fore[at - 1, :1] + pair[0], fore[at - 1, 1:] + pair[1])
    for t in range(length.max() - 1, 0, -1):
        at = first[: active[t]] + t
        onward = own[at] + back[at]
        back[at - 1] = np.logaddexp(onward[:, :1] + pair[:, 0], onward[:, 1:] + pair[:, 1])
    both = fore + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    inner = np.flatnonzero(chain[1:] == chain[:-1])
    moves = np.exp(fore[inner][:, :, None] + pair[None] + (own + back)[inner + 1][:, None, :] - total[inner][:, None, None])
    full = np.zeros((len(chain), 2, 2))
    full[inner + 1] = moves
    return np.exp(both[:, 1] - total), full, total


def _mean(chance: np.ndarray, text: np.ndarray, length: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(text, chance * length, minlength=texts) / np.bincount(text, length, minlength=texts)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(stats: np.ndarray, text: np.ndarray, length: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Field:
    """Fit the field; ``label`` is 0 or 1 per text. Chains weigh alike, whatever their length."""
    edges = np.stack([np.quantile(s, np.linspace(0, 1, BINS + 1)[1:-1]) for s in stats.T]) if len(stats) else np.zeros((len(NAMES), BINS - 1))
    size = _size(edges)
    if len(set(label.tolist())) < 2:
        return Field(edges, np.zeros(size), np.zeros((2, 2)), (1.0, 0.0), float(label.mean()) if len(label) else 0.5)
    held = _features(edges, stats, text)
    place = np.arange(len(text)) - np.searchsorted(text, text)
    chain = text * (1 + place.max() // CHAIN) + place // CHAIN
    good = label[text].astype(float)
    _, number, lines = np.unique(chain, return_inverse=True, return_counts=True)
    weight = 1.0 / lines[number]
    weight /= weight.sum()
    inner = np.concatenate([[False], chain[1:] == chain[:-1]])
    y = label[text]
    seen = np.array([[(weight * inner * (y == i) * (y == j)).sum() for j in (0, 1)] for i in (0, 1)])
    values = np.zeros(size + 4)
    slow, square = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, steps + 1):  # gradient ascent with momentum on the log-likelihood, weights held small
        weights, pair = values[:size], values[size:].reshape(2, 2)
        chance, moves, _ = _chances(weights[held].sum(axis=1), chain, pair)
        rest = weight * (good - chance)
        slope = np.concatenate([np.bincount(held.ravel(), np.repeat(rest, held.shape[1]), minlength=size), (seen - (weight[:, None, None] * moves).sum(axis=0)).ravel()]) - 1e-4 * values
        slow, square = 0.9 * slow + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        values = values + 0.1 * (slow / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights, pair = values[:size], values[size:].reshape(2, 2)
    chance, _, _ = _chances(weights[held].sum(axis=1), text, pair)
    x = _logit(_mean(chance, text, length, len(label)))
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton steps for the curve, with a small pull to a = 1
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-6
        hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(hess, [((label - p) * x).sum() - (a - 1), (label - p).sum() - 1e-3 * b])
        a, b = a + np.clip(move[0], -1, 1), b + np.clip(move[1], -1, 1)
    return Field(edges, weights, pair, (float(max(a, 0.05)), float(b)))


def _score(field: Field, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            scores = []
            for _, data, starts in text_slices(batch.column(1)):
                texts = len(starts) - 1
                if field.constant is not None:
                    scores.append(np.full(texts, field.constant))
                    continue
                stats, text, length = line_statistics(data, starts)
                chance, _, _ = _chances(field.weights[_features(field.edges, stats, text)].sum(axis=1), text, field.pair)
                a, b = field.curve
                scores.append(1 / (1 + np.exp(-(a * _logit(_mean(chance, text, length, texts)) + b))))
            out = np.concatenate(scores) if scores else np.empty(0)
            kept = [i for i in range(batch.num_columns) if i != 1 or with_text]
            yield pa.RecordBatch.from_arrays([*(batch.columns[i] for i in kept), pa.array(out, pa.float64())], [*(batch.schema.names[i] for i in kept), "score"])

    return run


def _statistics(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        label = batch.column(2).to_numpy()
        for row, data, starts in text_slices(batch.column(1)):
            stats, text, length = line_statistics(data, starts)
            cuts = np.searchsorted(text, np.arange(1, len(starts) - 1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(row, len(starts) - 1), pa.array(label[row : row + len(starts) - 1], pa.int32()),
                pa.array([x.tobytes() for x in np.split(stats, cuts)], pa.binary()), pa.array([x.astype(np.int32).tobytes() for x in np.split(length, cuts)], pa.binary()),
            ], ["doc_id", "label", "stats", "lengths"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Field:
    """Fit a field on the labelled texts of the ``sample`` ids with the smallest hash."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    chosen = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(_statistics, "doc_id long, label int, stats binary, lengths binary").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.stats))
    stats = [np.frombuffer(r.stats, dtype=np.float32).reshape(-1, len(NAMES)) for r in rows]
    lengths = [np.frombuffer(r.lengths, dtype=np.int32) for r in rows]
    text = np.repeat(np.arange(len(rows)), [len(x) for x in lengths])
    empty = np.zeros((0, len(NAMES)), dtype=np.float32)
    return fit(np.concatenate([empty, *stats]), text, np.concatenate([np.empty(0, dtype=np.int32), *lengths]), np.array([r.label for r in rows], dtype=np.int64))


def line_field_quality(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Row per text: its id as ``doc_id``, the columns ``keep``, and ``score`` (0 to 1)."""
    kinds = dict(docs.dtypes)
    others = [c for c in keep if c not in (id_col, text_col)]
    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`") for c in others])
    schema = ", ".join(["doc_id long", *["text string"] * (text_col in keep), *[f"`{c}` {kinds[c]}" for c in others], "score double"])
    return inputs.mapInArrow(_score(field, text_col in keep), schema)
