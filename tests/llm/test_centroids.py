"""Clusters against a plain version with whole numbers, ties, repeated vectors, and vectors that take no part."""

import hashlib
import math
import os
import sys

import numpy as np
import pytest

pytest.importorskip("tablewright.llm.queries")
sys.path.insert(0, os.path.dirname(__file__))

import cases  # noqa: E402
from tablewright.llm import centroids as C  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label int"
OUT = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def plain(rows, k=C.K, dims=C.DIMS, rounds=C.ROUNDS):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    cents = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(cents)):
            own = [v for (_, v), (_, m) in zip(kept, near) if m == n]
            if own:
                cents[n] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    sums = {n: sum(d for d, m in near if m == n) for n in range(len(cents))}
    return sorted(((i, n, d, sums[n], sum(sums.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, near)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def grouped(rng, n, spread=0.3):
    centres = rng.normal(size=(12, 64))
    return [(i, (centres[rng.integers(12)] + rng.normal(scale=spread, size=64)).tolist()) for i in range(n)]


def test_against_plain_version(spark):
    rows = grouped(np.random.default_rng(1), 400)
    assert cases.as_rows(C.clusters(frame(spark, rows)), *OUT) == plain(rows)


def test_ties_copies_and_coarse_grid(spark):
    """Components of -1, 0 and 1 in steps: many equal distances, equal vectors and equal centroids."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 2)] + [0.0] * 62) for i in range(200)]
    assert cases.as_rows(C.clusters(frame(spark, rows)), *OUT) == plain(rows)


def test_what_takes_no_part(spark):
    rng = np.random.default_rng(3)
    good = grouped(rng, 70)
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [1.0] * 63 + [None]), (905, [float("nan")] + [0.0] * 63), (906, [float("inf")] + [0.0] * 63), (907, [0.0] * 63 + [-float("inf")])]
    awkward = [(None, good[0][1]), (None, None), (3, good[5][1]), (3, good[3][1])]
    rows = good + bad + awkward
    docs = cases.with_clashes(frame(spark, rows), "cluster", "distance", "vector", "v", "hash", "n", "sums")
    assert cases.as_rows(C.clusters(docs), *OUT) == plain(rows)


def test_few_vectors_and_none(spark):
    rows = grouped(np.random.default_rng(4), 7)
    assert cases.as_rows(C.clusters(frame(spark, rows)), *OUT) == plain(rows)
    assert C.clusters(frame(spark, rows).limit(0)).collect() == []
    assert C.clusters(frame(spark, [(1, None), (2, [1.0])])).collect() == []


def test_huge_components_are_set_to_the_limit(spark):
    rows = [(i, [3e38 if i % 2 else -3e38] * 64) for i in range(4)]
    got = C.clusters(frame(spark, rows)).collect()
    assert sorted(r.distance for r in got) == [0, 0, 0, 0]


def test_tree_equals_all_centroids_and_skips_some():
    rng = np.random.default_rng(6)
    for _ in range(20):
        n = int(rng.integers(1, 60))
        cents = rng.integers(-300, 300, (n, 8)) if rng.random() < 0.7 else rng.integers(0, 2, (n, 8))
        vectors = np.concatenate([cents[rng.integers(0, n, 200)] + rng.integers(-40, 41, (200, 8)), cents])
        number, distance, _ = C.nearest(C.build(cents), vectors)
        exact = C.squared(vectors, cents)
        assert (distance == exact.min(axis=1)).all() and (number == exact.argmin(axis=1)).all()
    cents = rng.integers(-3000, 3000, (40, 64))
    vectors = cents[rng.integers(0, 40, 500)] + rng.integers(-300, 300, (500, 64))
    assert C.nearest(C.build(cents), vectors)[2] < 500 * 40
