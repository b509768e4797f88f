"""One column per case: what comes out, and whether the gate opens."""

import datetime as dt

import pytest

from tablewright.operators import cleaners as C
from tablewright.plans.cleaning import CleaningPlan, measure_plan, run_cleaners

TWO_DIGIT = ["85", "90", "05", "22"]
CASES = [
    (C.NULL_STRINGS, "v", ["hello", "N/A", "null", "None", "world", "-", "."], ["hello", None, None, None, "world", None, None]),
    (C.NULL_STRINGS, "v", ["n/a", "NA", "Null", "NONE", "valid"], [None, None, None, None, "valid"]),
    (C.NULL_STRINGS, "v", ["hello", None, "NULL", " N/A "], ["hello", None, None, None]),
    (C.PERCENTAGES, "v", ["45%", "78.5%", "1,100%", "N/A"], [45.0, 78.5, 1100.0, None]),
    (C.PERCENTAGES, "v", ["45%", "a", "b", "c", "d"], ["45%", "a", "b", "c", "d"]),
    (C.BOOLEANS, "v", ["Yes", "No", "yes", "NO", "Y", "N"], [True, False, True, False, True, False]),
    (C.BOOLEANS, "v", ["True", "x", "y z", "w"], ["True", "x", "y z", "w"]),
    (C.BOOLEANS, "v", ["on", "off", "active", "maybe"], [True, False, True, None]),
    (C.YEARS, "Year", ["2020.0", "2021.0", "2022.0"], [2020, 2021, 2022]),
    (C.YEARS, "Year", TWO_DIGIT, [1985, 1990, 2005, 2022]),
    (C.YEARS, "fiscal_period", ["30", "31", "3000", "1999"], [2030, 1931, None, 1999]),
    (C.YEARS, "Name", ["ann", "bob"], ["ann", "bob"]),
    (C.YEARS, "Name", TWO_DIGIT, TWO_DIGIT),
    (C.PHONES, "Phone", ["(555) 123-4567", "+1-555-123-4567", "555.123.4567"], ["5551234567", "+15551234567", "5551234567"]),
    (C.PHONES, "hotel", ["(555) 123-4567", "555.123.4567"], ["(555) 123-4567", "555.123.4567"]),
    (C.WHITESPACE, "v", ["a​b", "a b", "  a   b ", "a\t\nb", "tidy", " x "], ["ab", "a b", "a b", "a b", "tidy", "x"]),
    (C.DATES, "created_date", ["2023-01-15", "01/15/2023", "Jan 15, 2023", "15/01/2023"], [dt.datetime(2023, 1, 15)] * 4),
    (C.DATES, "Year", ["2020", "2021", "2022"], ["2020", "2021", "2022"]),
    (C.NEGATIVE_PARENS, "v", ["100", "(200)", "300", "(400.50)"], [100.0, -200.0, 300.0, -400.5]),
    (C.NEGATIVE_PARENS, "v", ["$100", "($200)", "$300", "($400)"], ["$100", "-200.0", "$300", "-400.0"]),
    (C.EMAILS, "Email", ["User@GMAIL.COM", "test@gmial.com", " hello@yahoo.com", "a@gmail.co"], ["user@gmail.com", "test@gmail.com", "hello@yahoo.com", "a@gmail.com"]),
    (C.INDIAN_NUMBERS, "v", ["1,23,456", "12,34,567", "1,00,000.50"], [123456.0, 1234567.0, 100000.5]),
    (C.INDIAN_NUMBERS, "v", ["1,234", "2,345", "3,456"], ["1,234", "2,345", "3,456"]),
    (C.TEXT_PREFIXES, "v", ["Writtenby: Ann", "narrated by Bob", "Cid"], ["Ann", "Bob", "Cid"]),
    (C.RATINGS, "v", ["4.5 out of 5 stars 234 ratings", "3 OUT OF 5 star", "none"], [4.5, 3.0, None]),
    (C.MOJIBAKE, "v", ["donâ€™t", "cafÃ©", "Â£5", "plain"], ["don't", "café", "£5", "plain"]),
    (C.REFERENCES, "v", ["12[1]", "13 [b]", "x"], ["12", "13", "x"]),
    (C.CURRENCY, "v", ["$1,200", "₹300", "€4.5[1]", "bad"], [1200.0, 300.0, 4.5, None]),
    (C.TEXT_TO_NUMERIC, "v", ["1,200", "3", "x", "4.5"], [1200.0, 3.0, None, 4.5]),
    (C.STANDARD_NUMBERS, "v", ["1,234.56", "1.234,56", "7"], ["1234.56", "1234.56", "7"]),
    (C.STANDARD_DATES, "v", ["2023-01-15", "01/16/2023", "17.01.2023", "2023-02-01", "2023-02-02"], ["2023-01-15", "2023-01-16", "2023-01-17", "2023-02-01", "2023-02-02"]),
    (C.PARSE_YEARS, "period", ["2020", "2021.0"], [2020, 2021]),
]


@pytest.mark.parametrize("cleaner,name,given,expected", CASES, ids=[f"{c[0].name}-{i}" for i, c in enumerate(CASES)])
def test_cleaner(spark, cleaner, name, given, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], f"i int, `{name}` string")
    out, audit = run_cleaners(df, [cleaner])
    assert [r[1] for r in out.orderBy("i").collect()] == expected
    assert bool(audit) == (given != expected)


def people(spark):
    rows = [("Ann", "85%", "Yes", "2020.0", "A@GMAIL.COM"), ("N/A", "92%", "No", "2021.0", "b@gmial.com"),
            ("Cid", "78%", "Yes", "2022.0", "c@yahoo.com"), ("Dan", "n/a", "No", "2019.0", "D@x.org")]
    return spark.createDataFrame(rows, "Name string, Score string, Active string, Year string, Email string")


def test_run_all_fires_each_kind(spark):
    out, audit = run_cleaners(people(spark))
    actions = {a["action"] for a in audit}
    assert {"CLEAN_NULL_STRINGS", "CLEAN_PERCENTAGES", "NORMALIZE_BOOLEANS", "CLEAN_YEARS", "NORMALIZE_EMAILS"} <= actions
    assert dict(out.dtypes) == {"Name": "string", "Score": "double", "Active": "boolean", "Year": "int", "Email": "string"}


def test_run_all_is_idempotent_and_order_free(spark):
    once, _ = run_cleaners(people(spark))
    twice, audit = run_cleaners(once)
    assert audit == []
    shuffled, _ = run_cleaners(people(spark).repartition(5))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) == sorted(map(str, shuffled.collect()))


def test_empty_table_has_no_audit(spark):
    assert run_cleaners(people(spark).limit(0))[1] == []


def test_plan_survives_json(spark):
    plan = measure_plan(people(spark), C.RUN_ALL)
    again = CleaningPlan.from_json(plan.to_json())
    assert again.apply(people(spark)).collect() == plan.apply(people(spark)).collect()
