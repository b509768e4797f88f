"""Text is measured once per distinct value; columns of long texts are measured over their rows."""

from tablewright.operators import profile as P
from tablewright.session import cut_lineage

ROWS = [(1, "  Ab ", "x" * 50, None), (2, "ab", "[1] " + "Y" * 50, None), (3, "AB", "x" * 50, None), (4, "a@b.com +1 555 123-4567", "$5", None), (5, "\u00a0ab", None, None),
        (6, "4111 1111 1111 1111", "", None), (7, "123-45-6789", " 7", None), (8, "[x] \u20b95", "short", None), (9, "", "short", None), (10, "1999-2001", "x" * 41, None)]
SCHEMA = "id long, mixed string, long_text string, empty string"


def test_values_tell_what_rows_tell(spark):
    df = spark.createDataFrame(ROWS + ROWS[:4], SCHEMA)
    found, digests = P.short_text_measures(cut_lineage(P.value_counts(df)))
    assert digests == ["long_text"] and set(found) == {"mixed"}
    wanted = {r.column_name: r.asDict() for r in P.text_measures(df).collect()}
    for r in P.text_distincts(df).collect():
        wanted[r.column_name].update(r.asDict())
    assert {"column_name": "mixed", **found["mixed"]} == wanted["mixed"]
    profile = P.measure(df)
    for name in ("mixed", "long_text", "empty"):
        own = profile.metric(name)
        assert {k: own[k] for k in wanted[name]} == wanted[name]
        assert own["present"] + own["missing"] == own["rows"] == 14
    assert profile.duplicates == 4
    assert [(t["value"], t["n"]) for t in profile.tops if t["column_name"] == "long_text"][:2] == [("x" * 50, 4), ("$5", 2)]


def test_text_alone_and_no_rows(spark):
    only = spark.createDataFrame([(None,), ("a",)], "t string")
    assert {k: P.measure(only).metric("t")[k] for k in ("rows", "present", "missing", "distinct", "distinct_norm")} == {"rows": 2, "present": 1, "missing": 1, "distinct": 1, "distinct_norm": 1}
    assert P.measure(only.limit(0)).metric("t")["rows"] == 0


def test_rows_are_not_compared_where_a_column_tells_them_apart(spark, monkeypatch):
    def compared(df):
        raise AssertionError("rows were compared")

    monkeypatch.setattr(P, "duplicate_summary", compared)
    assert P.measure(spark.createDataFrame(ROWS, SCHEMA)).duplicates == 0
