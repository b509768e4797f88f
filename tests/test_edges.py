"""Inputs that once gave wrong answers: not-a-number, odd dates, line ends in files, repeated headers, empty and constant columns."""

import importlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablewright.functions.dates import parse_date
from tablewright.functions.text import name_has_token, title_case
from tablewright.operators import catalogue, correct, impute, insights, predict
from tablewright.operators import profile as P
from tablewright.operators import text as G
from tablewright.sources import readers, writers


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert P.missing_counts(df).first().missing == 2
    assert P.measure(df).metric("x")["missing"] == 2 and P.overview(df).first().total_missing == 2
    out = impute.impute_with(df, "median_indicator", ["x"]).collect()
    assert sorted((r.x, r.x_was_missing) for r in out) == [(1.0, 0), (2.0, 1), (2.0, 1), (3.0, 0)]


def test_duplicates_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), (None, None)], "x string, y string")
    assert P.duplicate_summary(df).first().exact_duplicates == 1


@pytest.mark.parametrize("text, want", [
    ("2024-01-01T10:00:00Z", "2024-01-01 10:00:00"), ("2024-01-01T10:00:00+05:30", "2024-01-01 04:30:00"), ("2024-01-01 10:00", "2024-01-01 10:00:00"),
    ("2024-01-01 10:00:00.123", "2024-01-01 10:00:00.123"), ("01/02/2023 10:30", "2023-01-02 10:30:00"), ("Jan 2023", "2023-01-01 00:00:00"), ("1/2/23", "2023-01-02 00:00:00"),
    ("Sept 5, 2023", "2023-09-05 00:00:00"), ("13/01/2023", "2023-01-13 00:00:00"), ("soon", None), ("2024-13-45", None)])
def test_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(parse_date(F.col("t")).cast("string").alias("d")).first().d
    assert got == want


def test_csv_keeps_line_ends(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a\nb "c", d'), (2, "plain"), (3, "x\r\ny")], "id int, t string")
    writers.write_csv(df, f"{tmp_path}/t")
    got = {r.id: r.t for r in readers.read_csv(spark, f"{tmp_path}/t", "id int, t string").collect()}
    assert got[1] == 'a\nb "c", d' and got[2] == "plain" and len(got) == 3


def test_headers_are_unique(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int").toDF("a", "a", "a_1", " a ")
    assert correct.clean_column_names(df)[0].columns == ["a", "a_2", "a_1", "a_3"]


def test_row_limit_holds_for_the_whole_query(spark):
    spark.range(100).selectExpr("id AS credit_limit").createOrReplaceTempView("limits")
    assert readers.read_catalog_sql(spark, "SELECT credit_limit FROM limits", limit=7).count() == 7
    with pytest.raises(ValueError):
        readers.statement("SELECT 1", "t")


def test_broken_payloads_are_listed(spark):
    df = spark.createDataFrame([(1, '[{"k": 1}]'), (2, '[{"k": 1'), (3, '{"k": 2'), (4, '{"k": 3}')], "id int, p string")
    assert sorted(r.id for r in readers.payload_rows(df, "p", "k int", ["id"]).collect()) == [1, 4]
    assert sorted(r.id for r in readers.malformed_payloads(df, "p", ["id"]).collect()) == [2, 3]


def test_names_and_titles(spark):
    assert name_has_token("order_date", ["date"]) and name_has_token("l_shipdate", ["date"]) and name_has_token("startDate", ["date"])
    assert not any(name_has_token(n, ["date", "time", "phone"]) for n in ("candidate", "mandate", "lifetime", "headphone"))
    got = spark.createDataFrame([("O'NEIL new-york",)], "t string").select(title_case(F.col("t")).alias("t")).first().t
    assert got == "O'Neil New-York"


def test_nested_json(spark):
    text = '{"zeta": "a long enough value here", "alpha": ["one", "two"], "short": "no", "deep": {"text": "something that is long enough to keep"}, "list": [{"inner": "another value, long enough to keep"}, "a text of a list that is long enough", 3]}'
    got = {r.path: r.chunk for r in G.json_to_chunks(spark.createDataFrame([(1, text), (2, "{broken"), (3, None)], "id int, p string"), "id", "p").collect()}
    assert got["/"] == "zeta: a long enough value here\nalpha: one, two"
    assert got[".deep"] == "text: something that is long enough to keep"
    assert got[".list[0]"] == "inner: another value, long enough to keep" and got[".list[1]"] == "a text of a list that is long enough"
    assert len(got) == 4


def test_constant_and_empty_columns(spark):
    constant = spark.createDataFrame([(i, 5.0) for i in range(30)], "id int, x double")
    assert catalogue.zscore_outliers(constant, "x", "id").count() == 0
    empty = spark.createDataFrame([(1, None)], "id int, x double")
    assert catalogue.zscore_outliers(empty, "x", "id").count() == 0
    assert predict.isolation_scores(empty, "x", "id").count() == 0
    assert predict.iqr_anomalies(empty, "x", "id").count() == 0
    few = spark.createDataFrame([(i, float(i), None if i < 2 else float(i)) for i in range(6)], "id int, f double, x double")
    assert predict.prediction_summary(few, "x", "id").filter("item = 'method statistical_fallback'").count() == 1
    assert insights.top_n_by_group(spark.createDataFrame([(1,)], "n int")).count() == 0
    assert insights.histograms(spark.createDataFrame([("a",)], "t string")).count() == 0


def test_unusable_vectors_are_left_out(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    queries = spark.createDataFrame([("q", [0.0, 0.0]), ("r", [3.0, 4.0])], "q string, v array<double>")
    got = [(r.query_id, r.rank, r.id, r.distance) for r in G.vector_top_k(df, "id", "v", queries, 5).orderBy("query_id", "rank").collect()]
    assert got == [("q", 1, 1, 0.0), ("q", 2, 5, 25.0), ("r", 1, 5, 0.0), ("r", 2, 1, 25.0)]
    assert sorted(r.id for r in G.unusable_vectors(df, "v", 2).collect()) == [2, 3, 4]


def test_many_categories_and_names(spark):
    import hashlib

    word = lambda i: "".join(chr(97 + b % 26) for b in hashlib.md5(str(i).encode()).digest()[:12])
    rows = [(word(i),) for i in range(300)] * 3 + [(word(7).upper(),), (word(8)[:-1],), ("item 17",), ("item 18",)]
    df = spark.createDataFrame(rows, "c string")
    assert [(r.old_value, r.new_value) for r in correct.case_variant_merges(df).collect()] == [(word(7).upper(), word(7))]
    merges = {r.old_value: r.new_value for r in correct.fuzzy_merges(df).collect()}
    assert merges[word(8)[:-1]] == word(8) and not {"item 17", "item 18"} & set(merges)


def test_a_hot_moment_is_split(spark):
    rows = [(i % 2, i, float(i) if i % 3 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "t int, id int, v double")
    from tablewright.functions.segments import segmented

    assert segmented(df, ["t", "id"], 8).select("__segment").distinct().count() == 8


def test_entry_without_the_text_subpackage(monkeypatch):
    real = importlib.import_module

    def gone(name, *rest):
        if name.startswith(("tablewright.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *rest)

    monkeypatch.setattr(entry.importlib, "import_module", gone)
    names = entry.queries()
    assert "p1_overview" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_cleaner_options_survive_a_plan(spark):
    from tablewright.operators import cleaners as C
    from tablewright.plans import cleaning

    df = spark.createDataFrame([("45%", "85", "gone"), ("78%", "35", "kept"), ("100%", "22", " Gone "), ("5%", "1999", "kept")], "rate string, year string, note string")
    plan = cleaning.measure_plan(df, [C.null_strings(("gone",)), C.percentages(True), C.years(40)])
    for p in (plan, cleaning.CleaningPlan.from_json(plan.to_json())):
        got = p.apply(df).collect()
        assert [r.rate for r in got] == [0.45, 0.78, 1.0, 0.05] and [r.year for r in got] == [1985, 2035, 2022, 1999] and [r.note for r in got] == [None, "kept", None, "kept"]


def test_audit_tells_what_was_lost(spark):
    from tablewright.operators import cleaners as C
    from tablewright.plans import cleaning

    df = spark.createDataFrame([("2024-01-01",), ("Jan 5, 2024",), ("soon",), (None,)], "order_date string")
    plan = cleaning.measure_plan(df, [C.DATES])
    row = cleaning.audit_frame(spark, plan.audit()).first()
    assert (row.rows_affected, row.detail) == (2, "2 of 3 values changed; 1 could not be read and are missing now")


def test_pages_token_by_token(spark):
    from tablewright.operators import text as G

    pages = {
        "<h1>One</h1><p>a<b>b</b></p><ul><li>x</li><li>y</li></ul>": "## One\na b \n - x\n- y",
        "<script>if (a<b) { x > 1 }</script>kept<STYLE>p {}</STYLE>": "kept",
        "<nav>a<nav>b</nav>c</nav>d</nav>e": "de",
        "<header>never closed <p>x</p>": "",
        "<pre>code</pre>&nbsp;&nbsp;a &amp; b<link rel=x>c": "```\ncode\n```\n  a  b c",
        "1 < 2 and <code>f()</code>\n\n\n\nend": "1 < 2 and `f()`\n\nend",
        "": "", "<>": "<>", "<script>open": "",
    }
    df = spark.createDataFrame([*enumerate(pages), (99, None)], "i int, html string").repartition(2)
    got = {r.i: r.t for r in df.select("i", G.html_to_text(df.html).alias("t")).collect()}
    assert got == {**dict(enumerate(pages.values())), 99: None}


def test_a_source_of_several_pages_is_ingested_as_often_as_its_status_has_it(spark):
    status = spark.createDataFrame([("a", "unchanged"), ("b", "changed"), ("b", "changed"), ("c", "unchanged"), ("c", "unchanged"), ("d", "removed"), ("e", "new")], "source string, status string")
    index = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "source string, chunk int")
    chunks = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30), ("e", 50)], "source string, chunk int")
    got = sorted(tuple(r) for r in G.delta_ingest(index, chunks, status).collect())
    assert got == [("a", 1), ("b", 20), ("b", 20), ("c", 3), ("c", 3), ("e", 50)]
