"""The mixture as rows: one text in two sources, clashing columns, null ids, no rows; and test items whose ids repeat."""

import os
import sys

import pytest

pytest.importorskip("tablewright.llm.queries")
sys.path.insert(0, os.path.dirname(__file__))

import cases  # noqa: E402
from tablewright.llm import decontam, mixing  # noqa: E402


def words_of(rows):
    out = {}
    for r in rows:
        out[r.source] = out.get(r.source, 0) + len(cases.words(r.text))
    return out


def planned(docs):
    out = {}
    for r in mixing.mix(docs).collect():
        out[r.source] = out.get(r.source, 0) + r.taken
    return {s: n for s, n in out.items() if n}


def test_one_id_and_text_in_two_sources(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "g h i", "y"), (None, "j k", "y"), (None, "j k", "x"), (3, "l", None), (3, "l", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert words_of(mixing.mixed_documents(docs).collect()) == planned(docs)


def test_clashing_columns_and_no_rows(spark):
    docs = cases.documents(spark)
    clash = cases.with_clashes(docs, "_id", "_digest", "_taken", "_size", "_round", "_cut", "__id", "taken", "size", "target")
    got = mixing.mixed_documents(clash)
    assert got.columns == clash.columns and words_of(got.collect()) == planned(docs)
    assert mixing.mixed_documents(docs.limit(0)).collect() == []


def test_items_count_once(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five six"), (3, "other")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "one two"), ("a", "three four"), (None, "five six"), ("b", "two three")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r["items"]) for r in decontam.contamination(docs, items).collect()}
    assert got == {1: (4, 2, ["a", "b"]), 2: (2, 0, []), 3: (0, 0, [])}
