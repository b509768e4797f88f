"""Operators that cut ordered work into pieces, against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions import distincts, quantiles
from tablewright.functions.quantiles import exact_quantiles
from tablewright.operators import catalogue, correct, impute, predict
from tablewright.operators import profile as P
from tablewright.operators import text as G

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def columns_of_numbers():
    r = random.Random(7)
    n = 3000
    return {
        "uniform": [r.random() for _ in range(n)], "heavy": [math.exp(r.gauss(0, 12)) for _ in range(n)],
        "signed": [r.gauss(0, 1) * 10 ** r.randint(-8, 8) for _ in range(n)], "few": [float(r.randint(0, 3)) for _ in range(n)],
        "hot": [5.0 if i % 3 == 0 else r.random() * 1e9 for i in range(n)], "gaps": [None if i % 2 else float(i) for i in range(n)],
        "same": [4.0] * n, "huge": [r.choice([-1.7e308, 1.7e308, 0.0, 1.0]) for _ in range(n)],
    }


def quantile(values, p):
    ordered = sorted(x for x in values if x is not None)
    at = p * (len(ordered) - 1)
    low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("limits", [{}, {"SIZE": 64, "CHUNK": 200}, {"SIZE": 64, "CHUNK": 200, "MOST": 40}, {"SIZE": 16, "CHUNK": 100, "MOST": 0, "SMALL": 0}], ids=str)
def test_exact_quantiles(spark, monkeypatch, limits):
    """Whole columns, short summaries, and brackets too full for the driver."""
    for name, value in limits.items():
        monkeypatch.setattr(quantiles, name, value)
    data = columns_of_numbers()
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in data)).repartition(5)
    found = exact_quantiles(df, data, PROBABILITIES)
    for c, values in data.items():
        for p, got in zip(PROBABILITIES, found[c]):
            assert got == quantile(values, p), (c, p)


@pytest.mark.parametrize("limits", [{}, {"SIZE": 16, "CHUNK": 100, "MOST": 0}], ids=str)
def test_limits_and_what_lies_beyond(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(quantiles, name, value)
    data = {k: v for k, v in columns_of_numbers().items() if k != "huge"}
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in data)).repartition(3)
    for c, s in P.measure_numbers(df).items():
        x = [v for v in data[c] if v is not None]
        q1, q3 = quantile(x, 0.25), quantile(x, 0.75)
        far = [v for v in x if v < q1 - 3 * (q3 - q1) or v > q3 + 3 * (q3 - q1)]
        assert (s["q1"], s["q3"], s["count"], s["min"], s["max"]) == (q1, q3, len(x), min(x), max(x))
        assert s["outliers"] == sum(v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1) for v in x), c
        assert (s["extremes"], s["min_extreme"], s["max_extreme"]) == (len(far), min(far, default=None), max(far, default=None)), c


def test_summaries_merge_in_any_order():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=30000), np.full(9000, 0.5), rng.exponential(size=20000) * 100])
    parts = [quantiles.Summary.of(p) for p in np.array_split(x, 23)]
    for order in (parts, parts[::-1], [quantiles.merged(parts[:9]), quantiles.merged(parts[9:])]):
        s = quantiles.merged(order)
        ordered = np.sort(x)
        assert s.n == len(x) and len(s.vals) <= quantiles.SIZE and s.error < len(x) // 1000
        for rank in (0, 1, 17, len(x) // 3, len(x) // 2, len(x) - 2, len(x) - 1):
            low, high = s.bracket(rank)
            assert low <= ordered[rank] <= high
            assert ((ordered >= low) & (ordered <= high)).sum() <= s.at_most(low, high)
        away = x - x.mean()
        for got, want in ((s.mean, x.mean()), (s.m2, (away**2).sum()), (s.m3, (away**3).sum()), (s.m4, (away**4).sum()), (s.total, x.sum())):
            assert got == pytest.approx(want, rel=1e-9)


def test_a_plan_reads_the_table_twice_for_quartiles_and_limits(spark, tmp_path):
    spark.range(30000).selectExpr("id", "cast(id % 97 as double) v", "cast(id * 7 % 20011 as double) w").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    tracker, before = spark.sparkContext.statusTracker(), set()
    spark.sparkContext.setJobGroup("quartiles", "quartiles")
    P.measure_numbers(df)
    jobs = set(tracker.getJobIdsForGroup("quartiles")) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 2 <= len(jobs) <= 3  # one per scan; the second adds up in one more stage, which may be a job of its own


def test_distinct_counts_in_one_scan(spark, monkeypatch):
    from tablewright.functions import distincts as D

    rows = [(i % 11, float(i % 7) if i % 5 else None, f"t{i % 13}", dt.date(2024, 1, 1 + i % 9), [i % 3], None) for i in range(2000)]
    rows += [(0, -0.0, "", None, None, None), (0, 0.0, None, None, [], None)]
    df = spark.createDataFrame(rows, "i int, x double, s string, d date, a array<int>, n string").repartition(4)
    want = {"i": 11, "x": 7, "s": 14, "d": 9, "a": 4, "n": 0}
    assert {r.column_name: r.distinct for r in P.distinct_counts(df).collect()} == want
    monkeypatch.setattr(D, "HELD", 3)
    monkeypatch.setattr(D, "FOLD", 4)
    monkeypatch.setattr(D, "RANGE_BYTES", 1 << 10)
    counted = P.distinct_counts(df)
    assert {r.column_name: r.distinct for r in counted.collect()} == want
    assert "Expand" not in counted._jdf.queryExecution().executedPlan().toString()
    assert P.distinct_counts(df.limit(0)).collect() == []


def test_numeric_profile_matches_pandas(spark):
    data = pd.DataFrame({k: v for k, v in columns_of_numbers().items() if k in ("uniform", "few", "gaps", "hot")}, dtype=float)
    rows = [tuple(None if math.isnan(x) else float(x) for x in r) for r in data.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data.columns))
    for r in P.moments(df).collect():
        s = data[r.column_name]
        for got, want in ((r["mean"], s.mean()), (r["std"], s.std()), (r.skewness, s.skew()), (r.kurtosis, s.kurt())):
            assert got == pytest.approx(want, rel=1e-9)
    want = data.corr()
    for r in P.correlations(df).collect():
        assert r.r == pytest.approx(want.loc[r.col1, r.col2], abs=1e-9)


def series(spark):
    r = random.Random(3)
    rows = [(("hot" if r.random() < 0.4 else f"k{r.randint(0, 5)}"), r.randint(0, 200), i, None if r.random() < 0.1 else float(r.randint(0, 99))) for i in range(600)]
    return rows, spark.createDataFrame(rows, "k string, t int, id int, v double").repartition(4)


@pytest.mark.parametrize("segments", [1, 7, 40])
def test_forward_fill(spark, segments):
    rows, df = series(spark)
    want = {}
    for k in {r[0] for r in rows}:
        last = None
        for _, t, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            last = v if v is not None else last
            want[i] = last
    got = {r.id: r.v for r in impute.forward_fill(df, "t", "id", ["k"], ["v"], segments=segments).collect()}
    assert got == want


@pytest.mark.parametrize("segments", [1, 9, 60])
def test_rolling_median(spark, segments):
    rows, df = series(spark)
    want = {}
    for k in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        for n, r in enumerate(ordered):
            near = [x[3] for x in ordered[max(0, n - 2):n + 3] if x[3] is not None]
            want[r[2]] = float(np.median(near)) if near else None
    got = {r.id: r.smoothed for r in catalogue.rolling_median(df, "v", "t", "id", ["k"], segments=segments).collect()}
    assert got == want


@pytest.mark.parametrize("segments", [1, 5, 30])
def test_neighbour_distances(spark, segments):
    r = random.Random(5)
    values = [round(r.gauss(0, 10), 1) for _ in range(300)] + [1.0] * 120 + [500.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in predict.neighbour_distances(df, "v", 10, segments).collect():
        near = sorted(abs(x - row.value) for x in values)[1:11]
        assert row.distance == pytest.approx(sum(near) / 10)
    assert predict.neighbour_outliers(df, "v", segments=segments)["outliers"] >= 1


@pytest.mark.parametrize("segments", [1, 6])
def test_spearman_drift_and_monotonic(spark, segments):
    rows, df = series(spark)
    pdf = pd.DataFrame(rows, columns=["k", "t", "id", "v"]).dropna()
    got = catalogue.spearman(df, "t", "v", segments).first().spearman
    assert got == pytest.approx(pdf["t"].rank().corr(pdf["v"].rank()), abs=1e-4)
    check = impute.monotonic_check(df, "t", "id", segments).first()
    t = [r[1] for r in sorted(rows, key=lambda r: r[2])]
    assert check.decreases == sum(b < a for a, b in zip(t, t[1:])) and check.increases == sum(b > a for a, b in zip(t, t[1:]))


def test_isolation_forest_finds_the_far_values(spark):
    r = random.Random(1)
    rows = [(i, r.gauss(0, 1)) for i in range(400)] + [(400, 60.0), (401, -55.0)]
    found = predict.isolation_scores(spark.createDataFrame(rows, "i int, v double"), "v", "i")
    anomalies = {x.i for x in found.filter("anomaly").collect()}
    assert {400, 401} <= anomalies and len(anomalies) <= 0.05 * 402 + 1


def test_fuzzy_merges(spark):
    values = ["Rowling, J.K."] * 5 + ["J.K. Rowling,"] * 2 + ["Chicago"] * 4 + ["Chcago"] + ["Acme Inc"] * 3 + ["The Acme"] + ["Austin"] * 2
    merges = {r.old_value: r.new_value for r in correct.fuzzy_merges(spark.createDataFrame([(v,) for v in values], "c string")).collect()}
    assert merges == {"J.K. Rowling,": "Rowling, J.K.", "Chcago": "Chicago", "The Acme": "Acme Inc"}


def test_vector_search_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(200, 8)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<float>").repartition(6)
    got = G.vector_top_k(df, "id", "v", {"q": [0.0] * 8}, 7).orderBy("rank").collect()
    want = np.argsort((vectors.astype("float64") ** 2).sum(axis=1))[:7]
    assert [r.id for r in got] == want.tolist()


def test_dedupe_and_imputation_keep_their_promises(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, 4, None), (3, 7, "b")], "i int, n int, s string")
    once = impute.remove_duplicates(df)
    assert once.count() == 3 and impute.remove_duplicates(once).count() == 3
    out = impute.impute(once, {"n": "median", "s": "mode"})[0].orderBy("i").collect()
    assert [(r.n, r.s) for r in out] == [(5.5, "a"), (4.0, "a"), (7.0, "b")]


def test_standardize_case_keeps_missing(spark):
    df = spark.createDataFrame([("north",), ("North",), (" NORTH",), (None,)], "r string")
    assert {r.r for r in impute.standardize_case(df)[0].collect()} == {"North", None}


def test_equal_values_of_a_stretch_are_looked_at_once(spark):
    df = spark.range(0, 30_000, 1, 3).selectExpr("concat('v', id % 7) AS a", "CASE WHEN id % 5 > 0 THEN cast(id AS STRING) END AS b", "cast(NULL AS STRING) AS c")
    rows = distincts.folded_values(df).collect()
    assert sum(r.key == 0 for r in rows) == 3 * 7 and sum(r.key == 2 for r in rows) == 3
    assert [sum(r.n for r in rows if r.key == k and r.value is not None) for k in range(3)] == [30_000, 24_000, 0]
    assert [sum(r.n for r in rows if r.key == k and r.value is None) for k in range(3)] == [0, 6_000, 30_000]
    assert distincts.folded_values(df.limit(0)).collect() == []
    flags = P.count_flags(P.folded_text(df), {"rows": F.lit(True), "threes": F.col("value") == "v3"})
    assert {r.column_name: (r.rows, r.threes) for r in flags.collect()} == {"a": (30_000, len(range(3, 30_000, 7))), "b": (30_000, 0), "c": (30_000, 0)}
