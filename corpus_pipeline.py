"""From raw documents to token files: five stages, each over all that the stage before it kept.

A stage takes (spark, docs, folder) and returns a DataFrame, which is written as Parquet and read again as the next stage's
``docs``. All stages but the last return the columns of ``docs``. Where a decision on a text is joined back to it, the rows get a
stored number of their own first, so rows without an id, or with the id of another text, are judged like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontam, mixing, quality, queries, similar, tokens
from tablewright.llm.shared import stored


def good_texts(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts whose line field gives a quality of at least 0.3."""
    field = quality.train(docs, queries.training_labels(spark, folder))
    scored = quality.line_field_quality(docs, field, keep=tuple(c for c in docs.columns if c != "doc_id"))
    return scored.where(F.col("score") >= queries.GOOD).select(*docs.columns)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for every row, stored, and the name of its column."""
    name = "row_number"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered", compression="zstd"), name


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One text of each class of near duplicates: the one with the smallest id, then the smallest md5 of its text, then the smallest row number; no id comes last."""
    rows, number = numbered(docs)
    classes = similar.near_duplicates(rows, id_col=number).select(F.col("doc_id").alias(number), "component_id")
    order = rows.select(number, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.md5("text").alias("digest"), number).alias("place"))
    first = classes.join(order, number).groupBy("component_id").agg(F.min("place").alias("place")).select(F.col(f"place.{number}").alias(number))
    return rows.join(first, number, "left_semi").select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts that the benchmark's windows don't cover by a twentieth or more."""
    rows, number = numbered(docs)
    hits = decontam.contamination(rows, queries.table(spark, folder, "benchmark"), id_col=number).where("contaminated").select(F.col("doc_id").alias(number))
    return rows.join(hits, number, "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mixture of sources: a text as often as it is taken, the last one of a source cut at the budget."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids written as directly addressable codes, and what is read back from them."""
    return tokens.read_texts(tokens.token_files(docs, queries.tokenizer_path()))


STAGES = [
    ("quality classifier", good_texts),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_files),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = queries.table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), "stage", compression="zstd")
    return docs


ORACLE_SQL = None  # a fitted field and a tokenizer are not SQL; tests/llm holds each stage against brute force
QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
