"""Sorted pointers against sorted words, and the audit against a plain version over whole numbers."""

import os
import re
import sys
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tablewright.llm.queries")
sys.path.insert(0, os.path.dirname(__file__))

import cases  # noqa: E402
from tablewright.llm import divergence as D  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string"
OUT = ("lang", "source", "part", "item", "value", "rank")


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", cases.lower(text))


def plain(rows, least=3, top=200):
    rows = [(t or "", lang or "", source or "") for _, t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        spread = Counter(w for t, x, _ in rows if x == lang for w in set(terms(t)))
        kept = [w for w, n in spread.items() if n >= least]
        count = {s: Counter(w for t, x, y in rows if (x, y) == (lang, s) for w in terms(t) if spread[w] >= least) for s in {r[2] for r in rows if r[1] == lang}}
        whole = sum(count.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            parts = {"pair": [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in count if o != s], "term": [(w, f(p[s][w], q[w])) for w in kept if count[s][w] and p[s][w] > q[w]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, n) for n, (i, v) in enumerate(ranked, 1) if part == "pair" or n <= top]
    return sorted(out, key=repr)


def compare(spark, rows, **options):
    got = cases.as_rows(D.audit(spark.createDataFrame(rows, SCHEMA), **options), *OUT)
    assert got == plain(rows, **options)
    return got


def made(rng, n=150, sources=5):
    words = [f"{chr(97 + i % 26)}{'xyzé漢'[i % 5] * (1 + i % 13)}{chr(97 + i % 7)}" for i in range(300)]
    rows = []
    for k in range(n):
        source = int(rng.integers(sources))
        own = (rng.zipf(1.3, int(rng.integers(0, 80))) * (source + 1)) % 300
        rows.append((k, " ".join(words[i].upper() if rng.random() < 0.2 else words[i] for i in own), ["en", "de"][k % 2], f"s{source}"))
    return rows


def test_against_plain_version(spark):
    got = compare(spark, made(np.random.default_rng(1)))
    assert {r[2] for r in got} == {"pair", "term"}


def test_nulls_empty_groups_and_repeats(spark):
    rows = made(np.random.default_rng(2), 60, 3)
    rows += [(1, None, "en", "s0"), (1, "again and again", "en", None), (None, "again and again", None, None), (2, "again\x00and7again_x", "", ""), (3, "", "fr", "only"), (4, None, "fr", None), (5, "never kept", "fr", "third"), (6, cases.LONG, "en", "s1")]
    got = compare(spark, rows)
    assert ("fr", "only", "pair", "", 0, 1) in got and ("fr", "only", "pair", "third", 0, 2) in got


def test_top_and_least(spark):
    compare(spark, made(np.random.default_rng(3), 80, 4), least=2, top=5)


def test_parts_added_up_in_small_pieces(spark, monkeypatch):
    for name, value in (("TERMS", 20), ("RUNS", 50), ("PAIRS", 7), ("SLICE", 200)):
        monkeypatch.setattr(D, name, value)
    rows = made(np.random.default_rng(4), 60, 6)
    frame = spark.createDataFrame(rows, SCHEMA)
    own = D._runs(frame.toArrow().select(["lang", "source", "text"]).to_batches())
    sums = Counter()
    for batch in own:
        for r in batch.to_pylist():
            sums[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter((x, s, w) for _, t, x, s in rows for w in terms(t))
    assert sums == want


def test_clashing_columns_and_empty_table(spark):
    rows = made(np.random.default_rng(5), 40, 3)
    frame = spark.createDataFrame(rows, SCHEMA)
    clash = cases.with_clashes(frame, "term", "n", "g", "h", "part", "item", "value", "rank", "p", "q", "zero", "total", "kept")
    assert cases.as_rows(D.audit(clash), *OUT) == plain(rows)
    assert D.audit(frame.limit(0)).collect() == []


def test_pointer_sort_equals_sorted_words():
    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(97, 100, int(rng.integers(1, 30))).tolist()) for _ in range(4000)] + [b"abcdefgh", b"abcdefghi", b"abcdefgh" * 3, b"abcdefgh" * 2, "漢字かな交じり文".encode()] * 3
    rng.shuffle(words)
    size = np.array([len(w) for w in words])
    first = np.cumsum(size + 1) - size - 1
    data = np.frombuffer(b" ".join(words) + b" " + b"\0" * 8, dtype=np.uint8)
    order, new = D.sorted_pointers(data, first, first + size)
    assert [words[i] for i in order] == sorted(words) and sorted(order.tolist()) == list(range(len(words)))
    assert [words[order[i]] for i in new] == sorted(set(words))
    runs = np.split(order, new[1:])
    assert all((np.diff(r) > 0).all() for r in runs)


def test_corrections_of_hot_terms_in_pieces(monkeypatch):
    """A term of 40 groups and many of two, cut into pieces of 7 pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    lists = [list(range(40)), *([int(a), int(a) + 1] for a in rng.integers(0, 39, 30))]
    p = [rng.integers(1, 10**9, len(x)).tolist() for x in lists]
    zero = [[5 + g for g in x] for x in lists]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64())) for x in (lists, p, zero)], ["g", "p", "zero"])
    f = lambda a, b: (a - b) ** 2 // b
    want = Counter()
    for x, own, none in zip(lists, p, zero):
        for i, g in enumerate(x):
            for j, h in enumerate(x):
                if g != h:
                    want[g, h] += f(own[i], own[j]) - f(own[i], none[j]) - f(none[i], own[j]) + f(none[i], none[j])
    for pairs in (7, 1 << 20):
        monkeypatch.setattr(D, "PAIRS", pairs)
        got = Counter()
        for out in D._corrections(iter([batch])):
            for r in out.to_pylist():
                got[r["g"], r["h"]] += (r["high"] << 32) + r["low"]
        assert got == want
