"""One query per operator over the shared tables, with the parameters meant for production, and SQL where it can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import centroids, decontam, divergence, mixing, pii, quality, rules, secret_scan, simhash, similar, suffix_tree, tokens, urls

GOOD = 0.3
HELD_OUT = "pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 5) = 0"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer file: TABLEWRIGHT_TOKENIZER, or the installed public one."""
    own = os.environ.get("TABLEWRIGHT_TOKENIZER")
    if own:
        return own
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def training_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").where(f"not ({HELD_OUT})")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar.near_duplicates(table(spark, folder, "documents"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages")).withColumn("purity", F.round("purity", 9))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.scores(table(spark, folder, "documents"))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality.line_field_quality(docs, quality.train(docs, training_labels(spark, folder)))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op9_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.read_texts(tokens.token_files(table(spark, folder, "documents"), tokenizer_path()))


def op10_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents")).drop("candidate")


def op11_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op12_source_divergence_audit(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clusters(table(spark, folder, "embeddings"))


QUERIES = {q.__name__: q for q in (
    op1_ngram_jaccard_join, op2_pii, op3_quality_rules, op4_url_filters, op5_mixing, op6_decontamination, op7_lm_scoring, op8_quality_classifier,
    op9_token_output, op10_secret_scans, op11_simhash_near_dedup, op12_source_divergence_audit, op13_centroid_clustering)}

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_PLAIN = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES: dict[str, str] = {
    "op4_url_filters": urls.SQL,
    "op5_mixing": f"""WITH sized AS (SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, sum(size) AS z, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
levels AS (SELECT *, max((sum_all - sum_up + 3 * z)::DOUBLE / (w_all - w_up + w)) OVER () AS level FROM (
  SELECT *, sum(z) OVER () AS sum_all, sum(w) OVER () AS w_all, sum(3 * z) OVER o AS sum_up, sum(w) OVER o AS w_up FROM sources
  WINDOW o AS (ORDER BY (3 * z)::DOUBLE / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))),
targets AS (SELECT source, CAST(z AS BIGINT) AS source_size, least((3 * z)::DOUBLE, level * w) AS target FROM levels),
placed AS (SELECT s.*, source_size, target, sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
rounds AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS r FROM placed)
SELECT doc_id, size, source_size, target, CAST(r * size + greatest(0, least(size, floor(target - r * source_size) - before)) AS BIGINT) AS taken FROM rounds""",
    "op6_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_PLAIN} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS g, least(len(w), 13) AS n FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT row, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT row, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM d, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT DISTINCT row, i, p.n, item_id FROM places p JOIN windows v ON p.g = v.g AND p.n = v.n),
words AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS k FROM hits) GROUP BY row),
items AS (SELECT row, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)""",
    "op12_source_divergence_audit": divergence.sql(),
    "op13_centroid_clustering": centroids.sql(),
}
