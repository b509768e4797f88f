"""Typo copies, basket pairs and CSV with quoted line ends, against plain versions."""

import csv
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.operators import catalogue
from tablewright.sources import quoted_csv, readers


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before if x == y else 1 + min(before, row[j], row[j - 1])
    return row[-1]


def with_typos(r, text, n):
    own = list(text)
    for _ in range(n):
        k, kind = r.randrange(len(own)), r.randrange(3)
        if kind == 0:
            own.insert(k, r.choice("xyz"))
        elif kind == 1:
            own.pop(k)
        else:
            own[k] = r.choice("xyz")
    return "".join(own)


def test_typo_copies_equal_all_pairs(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(300)]
    texts = []
    for size in (64, 66, 70, 90, 127, 128, 130, 255, 256, 257, 400):
        for _ in range(3):
            base = " ".join(r.choice(words) for _ in range(200))[:size].strip().ljust(size, "q")
            texts += [base, *(with_typos(r, base, k) for k in (1, 2, 3, 3, 5)), base.upper()]
    texts += ["short", "shart", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    forms = {}
    for i, t in enumerate(texts):
        f = " ".join((t or "").lower().split())
        if len(f) >= catalogue.SHORTEST_COPY:
            forms.setdefault(f, i)
    want = {}
    own = list(forms)
    for x in range(len(own)):
        for y in range(x):
            if abs(len(own[x]) - len(own[y])) <= 3 and (d := edits(own[x], own[y])) <= 3:
                a, b = sorted((forms[own[x]], forms[own[y]]))
                want[a, b] = d
    got = {(x.first_id, x.copy_id): x.edits for x in catalogue.typo_copies(df, "id", "t").collect()}
    assert got == want and len(want) > 100
    assert catalogue.typo_copies(df.limit(0), "id", "t").collect() == []


def test_typo_copies_are_never_broadcast(spark):
    """Joins after array functions are sorted: what Spark takes those to return is no measure. A text of 98 characters is a few rows."""
    df = spark.range(400).selectExpr("id", "concat(md5(cast(id AS STRING)), ' ', md5(concat('x', id)), ' ', md5(concat('y', id))) AS t")
    df = df.union(df.selectExpr("id + 1000", "concat('z', substr(t, 2))"))
    plan = catalogue.typo_copies(df, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    rows = df.select("id", F.col("t").alias("form")).mapInArrow(catalogue._kept_hashes, "key long, id long, size int, rule int, counts binary")
    assert rows.count() < 30 * 800


def test_sliding_least():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 1000, 57).astype(np.uint64)
    for width in (1, 2, 7, 19, 57):
        assert catalogue.sliding_least(x, width).tolist() == [int(x[i : i + width].min()) for i in range(len(x) - width + 1)]


@pytest.mark.parametrize("group", [256, 3])
def test_basket_pairs_equal_plain_counts(spark, monkeypatch, group):
    monkeypatch.setattr(catalogue, "ITEM_GROUP", group)
    r = random.Random(2)
    baskets = {b: {f"i{min(int(r.expovariate(0.2)), 30)}" for _ in range(r.randint(1, 12))} for b in range(400)}
    rows = [(b, i) for b, items in baskets.items() for i in items] + [(0, i) for i in baskets[0]]
    got = {(x.item_a, x.item_b): (x.together, x.support) for x in catalogue.basket_pairs(spark.createDataFrame(rows, "b int, i string"), "b", "i", 0.02).collect()}
    count = Counter((a, b) for items in baskets.values() for a in items for b in items if a < b)
    assert got == {p: (n, round(n / 400, 6)) for p, n in count.items() if n >= 8}


def test_a_hot_basket_is_not_taken_apart(spark):
    """One basket of 100,000 items beside many small ones: few of its items are frequent, and none of its pairs is a row."""
    hot = spark.range(100_000).selectExpr("0L AS b", "id AS i")
    small = spark.range(1, 3001).selectExpr("id AS b", "explode(array(id % 7, 7 + id % 5, 100 + id)) AS i")
    got = {(x.item_a, x.item_b): x.together for x in catalogue.basket_pairs(hot.union(small), "b", "i", 0.01).collect()}
    want = Counter((k % 7, 7 + k % 5) for k in range(1, 3001))
    assert got == {p: n + 1 for p, n in want.items() if n + 1 >= 0.01 * 3001}


def cells(r):
    parts = ["a", ",", '"', "\n", "\r\n", " ", "é", "x y", '""', "1"]
    return "".join(r.choice(parts) for _ in range(r.randrange(6))).replace("\r\n", "\n")


def test_quoted_line_ends_in_many_ranges(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, cells(r) or None, f"end {i}") for i in range(3000)]
    for name, part in (("a.csv", rows[:2500]), ("b.csv", rows[2500:])):
        with open(tmp_path / name, "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["i", "t", "e"])
            w.writerows([(i, "" if t is None else t, e) for i, t, e in part])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        ranges = spark.read.text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        got = sorted(tuple(x) for x in readers.read_csv(spark, str(tmp_path), "i int, t string, e string").collect())
        whole = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema("i int, t string, e string").csv(str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ranges > 10
    assert got == sorted(tuple(x) for x in whole)
    assert [x[0] for x in got] == list(range(3000)) and [x[2] for x in got] == [f"end {i}" for i in range(3000)]


def test_records_of_odd_files(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes(b'h\r\n"one\r\ntwo"\r\nplain\r\n\r\n"a""b"\r\n"last\n\n"')
    got = [(x.record, x.text) for x in quoted_csv.quoted_records(spark, str(tmp_path)).orderBy("record").collect()]
    assert got == [(1, "h"), (2, '"one\r\ntwo"'), (3, "plain"), (5, '"a""b"'), (6, '"last\n\n"')]
    (tmp_path / "d.csv").write_bytes(b"")
    assert quoted_csv.quoted_records(spark, str(tmp_path / "d.csv")).collect() == []


def test_ranges_check_writes_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task writes all texts: as many files as the input has parts."""
    from checks import connecting

    rows = [(i, f"one \"{i}\"\ntwo, {i}", "en") for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(connecting, "folder", lambda s: str(tmp_path / "csv"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = sorted(tuple(r) for r in connecting.csv_in_ranges(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == rows and len(list((tmp_path / "csv").glob("part-*"))) >= 4
