"""Merges of categories read the table once, whatever kinds of them are asked for."""

from tablewright.operators import correct


def test_merges_count_the_values_of_a_table_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    data = [("Boston",)] * 5 + [("boston",)] * 2 + [("Bostonn",)] * 1 + [("Chicago",)] * 4 + [("Chcago",)] * 1 + [(None,)] * 3
    df = spark.createDataFrame(data, "city string").mapInArrow(seen, "city string")
    found = {(r.old_value, r.new_value, r.n, r.type) for r in correct.category_merges(df).collect()}
    assert found == {("boston", "Boston", 2, "case_variant"), ("Bostonn", "Boston", 1, "fuzzy_merge"), ("Chcago", "Chicago", 1, "fuzzy_merge")}
    assert rows.value == len(data)
    alone = {(r.old_value, r.new_value, r.n) for r in correct.category_merges(df, fuzzy=False).collect()}
    assert alone == {("boston", "Boston", 2)}
