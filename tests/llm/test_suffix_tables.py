"""The stored suffix tree against a plain version of its definition, with more symbols and contexts than were once allowed."""

import math
import os
import sys
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tablewright.llm.queries")
sys.path.insert(0, os.path.dirname(__file__))

import cases  # noqa: E402
from tablewright.llm import suffix_tree as S  # noqa: E402


def plain_scores(rows):
    """Sum of log10 of every text: all contexts of S.LEAST occurrences, by their left-one-out gain."""
    words = [(i, [*cases.words(cases.lower(t or "")), "<end>"]) for i, t in rows]
    train = [w for i, w in words if cases.fold(i, 7) != 2]
    counts = Counter(x for w in train for x in w)
    n, v = sum(counts.values()), len(counts)
    d = min(0.9, max(0.1, sum(c == 1 for c in counts.values()) / v))
    symbol = lambda x: x if counts[x] >= S.LEAST or x == "<end>" else "<other>"
    root = {x: (c - d) / n for x, c in counts.items() if symbol(x) == x}
    root["<other>"] = sum(c - d for x, c in counts.items() if symbol(x) != x) / n + d * v / n

    def contexts(w, t):
        before = ("<end>", *map(symbol, w[:t]))
        return [before[len(before) - k :] for k in range(1, min(S.DEPTH, len(before)) + 1)]

    follows = {}
    for w in train:
        for t, x in enumerate(w):
            for c in contexts(w, t):
                follows.setdefault(c, Counter())[symbol(x)] += 1
    follows = {c: f for c, f in follows.items() if sum(f.values()) >= S.LEAST}
    total = {c: sum(f.values()) for c, f in follows.items()}
    kept = set()
    for c, f in follows.items():
        gain = 0.0
        for x, m in f.items():
            wide = root[x] if len(c) == 1 else (follows[c[1:]][x] + S.PULL * root[x]) / (total[c[1:]] + S.PULL)
            gain += m * math.log2((m - 1 + S.PULL * wide) / (total[c] - 1 + S.PULL) / wide)
        if gain >= S.DIVERGENCE:
            kept |= {c[j:] for j in range(len(c))}

    def chance(w, t):
        x = w[t]
        p = root[symbol(x)]
        for c in contexts(w, t):
            if c not in kept:
                break
            p = (follows[c][symbol(x)] + S.PULL * p) / (total[c] + S.PULL)
        if symbol(x) != x:
            p *= ((counts[x] - d) / n if counts[x] else d * v / n) / root["<other>"]
        return p

    return {i: sum(math.log10(chance(w, t)) for t in range(len(w))) for i, w in words}, len(kept)


def compare(spark, rows):
    want, states = plain_scores(rows)
    got = {r.doc_id: r.score for r in S.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == want.keys()
    assert np.allclose([got[i] for i in want], list(want.values()), rtol=1e-9)
    return states


def test_every_word_and_context_counts(spark):
    """4,300 frequent words that each foretell the next one: more words and more states than 4,096."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(45):
        order = rng.permutation(4300)
        rows += [(50 * k + j, " ".join(f"a{i} b{i}" for i in order[j * 100 : j * 100 + 100])) for j in range(43)]
    assert compare(spark, rows) > 4096


def test_tables_larger_than_what_is_sent(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(S, "SENT", 6)
    monkeypatch.setattr(S, "INLINE", 9)
    rows = []
    for k in range(150):
        own = [1, 2]
        while len(own) < 80:
            own.append((own[-1] + own[-2]) % 12 if rng.random() < 0.7 else int(rng.geometric(0.06)))
        rows.append((k, " ".join(f"w{x}" for x in own)))
    assert compare(spark, [*rows, (900, None), (901, ""), (902, "never seen words")]) > 40


def chained(rng, texts, words=12):
    rows = []
    for k in range(texts):
        own = [1, 2]
        while len(own) < 80:
            own.append((own[-1] + own[-2]) % words if rng.random() < 0.7 else int(rng.geometric(0.06)))
        rows.append((k, " ".join(f"w{x}" for x in own)))
    return rows


def test_small_blocks_and_hashed_keys(spark, monkeypatch):
    """Blocks of a few texts, and symbols whose numbers side by side take more than 64 bits."""
    rows = [*chained(np.random.default_rng(6), 90), (901, None), (902, "w1 w2 never seen"), (None, "w1 w2 w3"), (None, "w1 w2 w3")]
    want = plain_scores(rows)[0]
    monkeypatch.setattr(S, "BLOCK", 200)
    for width in (None, 30):
        if width:
            monkeypatch.setattr(S.Facts, "width", property(lambda self: width))
        found = S.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(found) == len(rows)
        assert np.allclose([r.score for r in found], [want[r.doc_id] for r in found], rtol=1e-9)


def test_what_is_exchanged_is_small(spark):
    """A pair of context and symbol goes out as a few bytes once per block: four longs a pair and task, shuffled three times and stored, did not fit the disk."""
    rng = np.random.default_rng(7)
    symbols = np.concatenate([np.arange(4000), rng.integers(0, 4000, 400_000)]).astype(np.uint64)
    keys, place = S._distinct(S._scattered(S._followed(symbols[:-1], 12, symbols[1:], 12)[0], 24), 24)
    assert (keys == np.unique(keys)).all() and place.max() == len(keys) - 1
    assert (S._from_steps(S._steps(keys), len(keys)) == keys).all()
    assert len(S._steps(keys)[1][2]) < 2 * len(keys)


def test_states_passing_a_small_filter_are_told_apart(spark, monkeypatch):
    """A filter that most contexts pass is doubled until few others do."""
    monkeypatch.setattr(S, "GATE_BITS", 7)
    gained = spark.createDataFrame([(i + (1 << 20), 0, 25.0 if i % 2 else 1.0) for i in range(400)], "key long, suffix long, gain double")
    bits, others = S.kept_states(gained, 3, 20.0, 20)
    keys = np.arange(400, dtype=np.uint64) + np.uint64(1 << 20)
    kept = S.passes(bits, keys) & ~S._among(others, keys)[0]
    assert len(others) <= 20 and len(bits) > 1 << 1
    assert kept.tolist() == [i % 2 == 1 for i in range(400)]
