"""Tables without text, without numbers, without rows: every operator that looks for one kind of column; options and edge cases beside."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewright.operators import catalogue, correct, impute, insights, predict
from tablewright.operators import cleaners as C
from tablewright.operators import profile as P
from tablewright.plans import cleaning, pipeline


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(i % 7, float(i) if i % 5 else None, i * 3) for i in range(40)] + [(1, 1.0, 3)] * 2, "a int, b double, c long")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(["north", "North ", "south"][i % 3], "x" if i % 4 else None) for i in range(30)], "r string, s string")


@pytest.fixture(scope="module")
def dates(spark):
    return spark.createDataFrame([(dt.date(2024, 1, 1 + i), i % 2 == 0) for i in range(10)], "d date, f boolean")


TEXT_ONLY = [correct.detect_encoding, correct.detect_format_mix, correct.detect_type_issues, correct.detect_semantic_issues, correct.case_variant_merges, correct.fuzzy_merges,
             correct.value_frequency_sample, correct.value_frequency_draw, correct.analyze, P.top_values, P.mode_frequency, P.mixed_type_flags, P.text_measures, P.text_distincts,
             catalogue.currency_mixing, catalogue.timezone_mixing]
NUMBER_ONLY = [P.moments, P.distribution_shapes, P.numeric_stats, P.iqr_outliers, P.correlation_pairs, insights.histograms, predict.suggest_bins]


@pytest.mark.parametrize("operator", TEXT_ONLY, ids=lambda f: f.__name__)
def test_without_text(numbers, dates, operator):
    assert operator(numbers).collect() == [] and operator(dates).collect() == []


@pytest.mark.parametrize("operator", NUMBER_ONLY, ids=lambda f: f.__name__)
def test_without_numbers(texts, dates, operator):
    assert operator(texts).collect() == [] and operator(dates).collect() == []


@pytest.mark.parametrize("operator", [*TEXT_ONLY, *NUMBER_ONLY], ids=lambda f: f.__name__)
def test_the_other_kind_still_answers(numbers, texts, operator):
    table = texts if operator in TEXT_ONLY else numbers
    assert operator(table).columns == operator(table.limit(0)).columns
    operator(table.limit(0)).collect()


def test_cleaning_numbers_alone(numbers):
    result = pipeline.auto_clean(numbers)
    assert (result.shape, result.new_shape) == ((42, 3), (40, 3))
    assert result.table.filter("b IS NULL").count() == 0
    assert [a["action"] for a in result.audit] == ["REMOVE_DUPLICATES", "IMPUTE_MEAN"]
    corrected = pipeline.auto_correct(numbers)
    assert corrected.audit == [] and corrected.table.collect() == numbers.collect()
    assert impute.standardize_case(numbers) == (numbers, [])


def test_cleaning_texts_and_dates_alone(texts, dates):
    result = pipeline.auto_clean(texts)
    assert {r.r for r in result.table.collect()} == {"North", "South"}
    assert pipeline.auto_clean(dates).table.count() == 10 and pipeline.auto_correct(dates).table.count() == 10
    assert P.full_profile(dates).count() == 2 and P.full_profile(texts).count() == 2


def test_every_cleaner_with_options_survives_a_plan(spark):
    df = spark.createDataFrame([("by: Ann",), ("BY: Bob",), ("seen: Cy",), ("plain",)], "who string")
    plan = cleaning.measure_plan(df, [C.prefix_cleaner(("by:", "seen:"))])
    for p in (plan, cleaning.CleaningPlan.from_json(plan.to_json())):
        assert [r.who for r in p.apply(df).collect()] == ["Ann", "Bob", "Cy", "plain"]
        assert [a["rows_affected"] for a in p.audit()] == [3]
    for cleaner in (C.null_strings(("gone",)), C.prefix_cleaner(("by:",)), C.percentages(True), C.years(40), *C.EVERY.values()):
        assert C.named(cleaner.name).name == cleaner.name
        assert C.named(cleaner.name).action == cleaner.action


def test_drift_and_encoding_without_values(spark):
    df = spark.createDataFrame([(1.0, "a", None), (2.0, "b", None), (None, "a", None)], "v double, k string, y double")
    one = catalogue.distribution_drift(df, "v", F.col("v") > 0).first()
    assert (one.ks_distance, one.mean_before, one.mean_after, one.drifted) == (None, None, 1.5, False)
    none = catalogue.distribution_drift(df.limit(0), "v", F.col("v") > 0).first()
    assert (none.ks_distance, none.drifted) == (None, False)
    assert [r.k_target for r in catalogue.target_encoding(df, "k", "y").collect()] == [None] * 3
    assert catalogue.target_encoding(df.limit(0), "k", "y").collect() == []


def test_correlation_with_one_column_equals_all_pairs(numbers):
    every = {frozenset((r.col1, r.col2)): r.r for r in P.correlations(numbers).collect()}
    one = {frozenset((r.col1, r.col2)): r.r for r in P.correlations(numbers, against="b").collect()}
    assert one.keys() == {k for k in every if "b" in k}
    assert all(abs(one[k] - every[k]) < 1e-12 for k in one)
    assert P.correlations(numbers, against="missing").collect() == []


@pytest.mark.parametrize("bytes_", [0, 1 << 20])
def test_corrections_of_either_size(spark, monkeypatch, bytes_):
    monkeypatch.setattr(correct, "MAPPED_BYTES", bytes_)
    df = spark.createDataFrame([("x", 1, "x"), ("y", 2, None), (None, 3, "z"), ("x", 1, "x")], "a string, n int, b string")
    fixes = spark.createDataFrame([("a", "x", "X"), ("a", "x", "W"), ("b", "x", "bx"), ("n", "2", "20"), ("n", "3", "no number"), ("gone", "x", "y"), ("a", None, "q")], "column_name string, old_value string, new_value string")
    got = sorted((tuple(r) for r in correct.apply_corrections(df, fixes).collect()), key=repr)
    assert got == sorted([("W", 1, "bx"), ("y", 20, None), (None, 3, "z"), ("W", 1, "bx")], key=repr)
    assert correct.apply_corrections(df, fixes.limit(0)) is df


def test_pieces_follow_the_rows(spark, monkeypatch):
    from tablewright.functions import segments

    monkeypatch.setattr(segments, "SEGMENT_ROWS", 10)
    assert segments.segmented(spark.range(1000), ["id"]).select("__segment").distinct().count() == 100


def test_only_what_changed_is_measured_again(spark, monkeypatch):
    rows = [(i, f"t{i % 5}", float(i % 9), ["x", "y", None][i % 3], i * 0.5) for i in range(60)]
    before = spark.createDataFrame(rows, "i int, s string, v double, t string, w double")
    known = P.measure(before)
    after = before.withColumn("t", F.coalesce("t", F.lit("z"))).withColumn("v", F.col("v") + 1).drop("w").withColumn("new", F.col("i") % 2)
    read = []
    real = P._measure
    monkeypatch.setattr(P, "_measure", lambda df, *rest, **more: read.append(df.columns) or real(df, *rest, **more))
    got = P.measure(after, known=known, changed={"t", "v"})
    assert read == [["v", "t", "new"]]
    want = P.measure(after)
    assert (got.rows, got.duplicates, got.tops) == (want.rows, want.duplicates, want.tops)
    strip = lambda m: {k: v for k, v in m.items() if v is not None and k != "quantiles"}
    assert [strip(m) for m in got.metrics] == [strip(m) for m in want.metrics]
    assert [(p["col1"], p["col2"]) for p in got.pairs] == [(p["col1"], p["col2"]) for p in want.pairs]
    assert all(abs(a["r"] - b["r"]) < 1e-9 for a, b in zip(got.pairs, want.pairs))


def test_states_of_batches_merge(spark):
    rows = [(i, float(i * 37 % 1009) if i % 4 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, v double")
    parts = [P.column_states(df.filter(f"i % 3 = {k}")) for k in range(3)]
    whole = {r.column_name: r for r in P.merge_states(parts[0].union(parts[1]).union(parts[2])).collect()}
    want = P.measure_numbers(df)
    for c, r in whole.items():
        assert (r.rows, r.present, r.min, r.max) == (3000, want[c]["count"], want[c]["min"], want[c]["max"])
        assert all(abs(r[k] - want[c][k]) < 1e-6 * max(1, abs(want[c][k])) for k in ("mean", "std", "skewness", "kurtosis", "total"))
        assert r.q25_low <= want[c]["q1"] <= r.q25_high and r.q50_low <= want[c]["median"] <= r.q50_high
