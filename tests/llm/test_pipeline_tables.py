"""Texts that the pipeline numbers are stored small."""

from corpus_pipeline import numbered


def test_numbered_texts_are_compressed(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows, name = numbered(docs)
    assert all(".zstd." in f for f in rows.inputFiles()) and rows.inputFiles()
    assert sorted((r.doc_id, r.text) for r in rows.collect()) == [(1, "a b"), (2, None)] and rows.select(name).distinct().count() == 2
