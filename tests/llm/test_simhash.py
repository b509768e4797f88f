"""Fingerprints bit by bit, the grid join against all pairs, hot tiles, awkward rows."""

import os
import sys

import numpy as np
import pytest
import xxhash

pytest.importorskip("tablewright.llm.queries")
sys.path.insert(0, os.path.dirname(__file__))

import cases  # noqa: E402
from tablewright.llm import simhash as S  # noqa: E402


def plain_print(text):
    w = cases.words(cases.lower(text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows, radius=3):
    """(id, fingerprint, component) per row: all pairs, rows of one id hang together, no id links nothing."""
    prints, own = [plain_print(t) for _, t in rows], {i: i for i, _ in rows if i is not None}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is not None and j is not None and bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = find(i), find(j)
                own[max(x, y)] = min(x, y)
    return sorted(((i, f"{p:016x}", None if i is None else find(i)) for (i, _), p in zip(rows, prints)), key=repr)


def compare(spark, rows):
    got = cases.as_rows(S.near_duplicates(cases.documents(spark, rows)), "doc_id", "fingerprint", "component_id")
    assert got == plain_classes(rows)
    return got


def test_awkward_rows(spark):
    compare(spark, cases.TEXTS)


def test_clashing_columns_and_empty_table(spark):
    docs = cases.documents(spark, cases.TEXTS)
    clash = cases.with_clashes(docs, "print", "component", "node", "least", "cell", "own", "a", "b", "fingerprint", "component_id")
    assert cases.as_rows(S.near_duplicates(clash), "doc_id", "fingerprint", "component_id") == plain_classes(cases.TEXTS)
    assert S.near_duplicates(docs.limit(0)).collect() == []


def test_random_and_near_texts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        words = rng.integers(0, 400, 120)
        for c in range(4):  # the text, and copies with more and more words changed
            own = words.copy()
            own[rng.choice(120, c, replace=False)] += 1000
            rows.append((4 * k + c, " ".join(f"w{x}" for x in own)))
    got = compare(spark, rows)
    assert 0 < sum(c != i for i, _, c in got)


def points(rng, centre, n, most):
    """Numbers that differ from the centre in at most ``most`` bits."""
    out = np.full(n, centre, dtype=np.uint64)
    for _ in range(most):
        out ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64) * (rng.random(n) < 0.7).astype(np.uint64)
    return np.unique(out)


def linked_classes(nodes, links):
    own = {int(x): int(x) for x in nodes}

    def find(x):
        while own[x] != x:
            own[x] = own[own[x]]
            x = own[x]
        return x

    for a, b in links:
        x, y = find(int(a)), find(int(b))
        own[max(x, y)] = min(x, y)
    return {x: find(x) for x in own}


@pytest.mark.parametrize("tile", [8, 1 << 14])
def test_grid_join_equals_all_pairs(spark, monkeypatch, tile):
    """Clouds of fingerprints around shared centres: hot cells, cut into many tiles in the first case."""
    monkeypatch.setattr(S, "TILE", tile)
    monkeypatch.setattr(S, "PAIRS", 1 << 10)
    rng = np.random.default_rng(11)
    prints = np.unique(np.concatenate([points(rng, rng.integers(0, 2**63, dtype=np.uint64), 60, 9) for _ in range(5)] + [np.array([0, 1, 2**64 - 1, 2**63], dtype=np.uint64)]))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    want = linked_classes(prints, zip(*(prints[x] for x in np.nonzero(near))))
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    got = [(np.int64(r.a).view(np.uint64), np.int64(r.b).view(np.uint64)) for r in S.near_links(frame, 3).collect()]
    assert linked_classes(prints, got) == want
    assert len(set(want.values())) > 5


def test_bound_never_exceeds_the_distance():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**64, 5000, dtype=np.uint64), rng.integers(0, 2**64, 5000, dtype=np.uint64)
    b[:2500] = a[:2500] ^ (np.uint64(1) << rng.integers(0, 64, 2500).astype(np.uint64))
    bound = S.manhattan(S.segment_counts(a), S.segment_counts(b))
    plain = [sum(abs(bin(int(x) >> s & 3).count("1") - bin(int(y) >> s & 3).count("1")) for s in range(0, 64, 2)) for x, y in zip(a, b)]
    assert bound.tolist() == plain and (bound <= np.bitwise_count(a ^ b)).all()


def test_dense_group_of_thousands_returns_few_links():
    rng = np.random.default_rng(6)
    own = points(rng, np.uint64(0x123456789ABCDEF0), 3000, 4)
    a, b = S.dense_links(own, own, 3)
    assert len(a) <= 2 * len(own)
    near = np.bitwise_count(own[:, None] ^ own[None, :]) <= 3
    assert linked_classes(own, zip(a, b)) == linked_classes(own, zip(*(own[x] for x in np.nonzero(near))))


def test_cells_are_never_sent_to_the_driver(spark):
    """A print has dozens of cells, which Spark sizes as one row: a table of prints just under the broadcast limit must not be joined by broadcast."""
    prints = spark.range(1000).selectExpr("xxhash64(id) AS print")
    links = S.near_links(prints)
    links.collect()
    for plan in (links._jdf.queryExecution().sparkPlan(), links._jdf.queryExecution().executedPlan()):
        assert "Broadcast" not in plan.toString() and "SortMergeJoin" in plan.toString()
