"""Decisions of the pipeline hold for rows without an id and for texts that share one."""

import os
import sys

import pytest

pytest.importorskip("corpus_pipeline")
sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline as P  # noqa: E402

SCHEMA = "doc_id long, text string, source string"


def text(k, n=40):
    return " ".join(f"word{k}x{i}" for i in range(n))


def test_one_of_each_row(spark):
    rows = [(5, text(1), "a"), (3, text(1) + " more", "b"), (None, text(1), "c"), (7, text(2), "a"), (7, text(3), "b"), (None, text(4), "a"), (None, text(4), "a"), (None, text(5), "a"), (9, "", "a"), (9, None, "a"), (None, "", "a")]
    kept = P.one_of_each(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    want = [(3, text(1) + " more", "b"), (7, text(2), "a"), (7, text(3), "b"), (None, text(4), "a"), (None, text(5), "a"), (9, "", "a"), (9, None, "a"), (None, "", "a")]
    assert sorted(map(tuple, kept), key=repr) == sorted(want, key=repr)


def test_contaminated_rows_without_an_id_go(spark, tmp_path):
    spark.createDataFrame([("t", text(1, 20))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "before " + text(1, 20), "a"), (None, text(2), "a"), (4, text(3), "a"), (4, text(1, 20) + " after", "b"), (6, text(1, 20), "a")]
    kept = P.uncontaminated(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([rows[1], rows[2]], key=repr)
