"""Source, sink and stream checks. Files are written under the session's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.cleaning import CASES
from checks.common import AS_OF, dirty_orders, dirty_orders_sql, quoted, table, union_all
from checks.rules import DIMENSIONS, GRADE, MISSING, SRC, profile, scored
from tablewright.operators import cleaners as X
from tablewright.operators import correct
from tablewright.plans import cleaning
from tablewright.session import ensure_checkpoint_dir
from tablewright.sources import readers, writers
from tablewright.streaming import stream

QUERIES, ORACLES = {}, {}


def folder(s):
    return f"{ensure_checkpoint_dir(s)}/files-{uuid.uuid4().hex}"


_CUSTOMER = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


def csv_round_trip(s, d):
    path = folder(s)
    writers.write_csv(table(s, d, "customer"), path)
    return readers.read_csv(s, path, _CUSTOMER)


def csv_inferred(s, d):
    path = folder(s)
    writers.write_csv(table(s, d, "documents").select("doc_id", "text", "lang"), path)
    return readers.read_csv(s, path)


def csv_latin(s, d):
    """Whole texts, but for characters that Latin-1 lacks, in a file that is not UTF-8."""
    path = folder(s)
    texts = table(s, d, "documents").select("doc_id", F.regexp_replace("text", "[^\n\\x{20}-\\x{FF}]", "").alias("text"))
    texts.write.option("header", True).option("encoding", "ISO-8859-1").option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv_any_encoding(s, path, "doc_id BIGINT, text STRING").withColumn("text", F.coalesce("text", F.lit("")))


QUERIES["s1_read_csv"] = csv_inferred
ORACLES["s1_read_csv"] = "SELECT CAST(doc_id AS INTEGER) AS doc_id, text, lang FROM documents"


def csv_in_ranges(s, d):
    """Texts with line ends, a file for each task that writes, read with a schema: lines find their records whatever range they lie in."""
    path = folder(s)
    writers.write_csv(table(s, d, "documents").select("doc_id", "text", "lang"), path)
    return readers.read_csv(s, path, "doc_id BIGINT, text STRING, lang STRING")


QUERIES["s1_read_csv_in_ranges"] = csv_in_ranges
ORACLES["s1_read_csv_in_ranges"] = "SELECT doc_id, text, lang FROM documents"
QUERIES["s2_read_csv_fallback_encoding"] = csv_latin
ORACLES["s2_read_csv_fallback_encoding"] = "SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\n\\x{20}-\\x{FF}]', '', 'g') AS text FROM documents"


def catalog_sql(s, d):
    table(s, d, "orders").createOrReplaceTempView("orders_table")
    return readers.read_catalog_sql(s, "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders_table GROUP BY o_orderstatus")


def whole_table(s, d):
    table(s, d, "nation").createOrReplaceTempView("nation_table")
    return readers.read_catalog_sql(s, table="nation_table")


QUERIES["s3_read_sql"] = catalog_sql
ORACLES["s3_read_sql"] = "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus"
QUERIES["s3_read_sql_table"] = whole_table
ORACLES["s3_read_sql_table"] = "SELECT * FROM nation"
_ROW = "k BIGINT, name STRING"


def payloads(s, d):
    """Customers packed as lists, envelopes under each key, single objects and CSV text."""
    one = F.to_json(F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))
    key = F.element_at(F.array(*[F.lit(k) for k in readers.ENVELOPE_KEYS]), (F.col("c_custkey") % 5 + 1).cast("int"))
    shape = F.col("c_custkey") % 4
    payload = (F.when(shape == 0, F.concat(F.lit("["), one, F.lit("]"))).when(shape == 1, F.concat(F.lit('{"'), key, F.lit('": ['), one, F.lit("]}")))
               .when(shape == 2, one).otherwise(F.concat(F.lit("k,name\n"), F.col("c_custkey").cast("string"), F.lit(","), F.col("c_name"))))
    packed = table(s, d, "customer").select("c_nationkey", payload.alias("payload"))
    return readers.payload_table(packed, "payload", _ROW, _ROW, ["c_nationkey"])


QUERIES["s4_read_json_payload"] = payloads
ORACLES["s4_read_json_payload"] = "SELECT c_nationkey, c_custkey AS k, c_name AS name FROM customer"
def broken_payloads(s, d):
    """Customers packed as lists and objects, of which every third is cut off."""
    one = F.to_json(F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))
    whole = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one)
    payload = F.when(F.col("c_custkey") % 3 == 0, F.substring(whole, 1, 12)).otherwise(whole)
    packed = table(s, d, "customer").select("c_custkey", payload.alias("payload"))
    good = readers.payload_rows(packed, "payload", _ROW, ["c_custkey"]).select("c_custkey", F.lit("row").alias("what"))
    return good.union(readers.malformed_payloads(packed, "payload", ["c_custkey"]).select("c_custkey", F.lit("malformed")))


QUERIES["s4_malformed_payloads"] = broken_payloads
ORACLES["s4_malformed_payloads"] = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'malformed' ELSE 'row' END AS what FROM customer"
QUERIES["s4_event_props"] = lambda s, d: readers.payload_rows(table(s, d, "events"), "props", "k BIGINT", ["event_id"])
ORACLES["s4_event_props"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"
QUERIES["s5_normalize_headers_api"] = lambda s, d: correct.normalize_headers(table(s, d, "nation").toDF(" N__NationKey ", "N_Name", "REGION__Key"))
ORACLES["s5_normalize_headers_api"] = "SELECT n_nationkey, n_name, n_regionkey AS region_key FROM nation"
QUERIES["s6_filter_pushdown_api"] = lambda s, d: readers.filtered_page(table(s, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, ["o_orderkey"], 50, 20)
ORACLES["s6_filter_pushdown_api"] = "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 50 OFFSET 20"
QUERIES["s7_write_csv"] = csv_round_trip
ORACLES["s7_write_csv"] = "SELECT * FROM customer"


def json_round_trip(s, d):
    path = folder(s)
    source = table(s, d, "documents")
    writers.write_json(source, path)
    return s.read.schema(source.schema).json(path)


QUERIES["s8_write_json"] = json_round_trip
ORACLES["s8_write_json"] = "SELECT * FROM documents"


def with_quality(s, d):
    path = folder(s)
    writers.write_with_quality_metadata(scored(s, d), profile(s, d), path, AS_OF, {"source": "orders"})
    data = s.read.parquet(f"{path}/data").agg(F.lit("rows_written").alias("metric"), F.count("*").cast("string").alias("value"))
    return s.read.parquet(f"{path}/quality").unionByName(data)


QUERIES["s9_write_with_quality_metadata"] = with_quality
ORACLES["s9_write_with_quality_metadata"] = DIMENSIONS + f"""SELECT 'rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM {SRC} UNION ALL SELECT 'rows_written', CAST(count(*) AS VARCHAR) FROM {SRC}
UNION ALL SELECT 'columns', '15' UNION ALL SELECT 'missing_cells', CAST(CAST(sum(missing) AS BIGINT) AS VARCHAR) FROM ms UNION ALL SELECT 'duplicate_rows', CAST(k AS VARCHAR) FROM dup UNION ALL SELECT 'source', 'orders'
UNION ALL SELECT 'quality_score', CAST(round(sum(score * weight), 1) AS VARCHAR) FROM dims UNION ALL SELECT 'grade', {GRADE.format(x='(SELECT sum(score * weight) FROM dims)')}
UNION ALL SELECT dimension, CAST(round(score, 1) AS VARCHAR) FROM dims"""


def streamed_clean(s, d):
    """A plan decided on the batch, stored as JSON, applied to the same rows arriving as a stream."""
    source, path = folder(s), folder(s)
    columns = ["order_id", "status", "discount_text", "is_urgent", "amount_inr"]
    batch = dirty_orders(s, d, *columns)
    batch.write.parquet(source)
    plan = cleaning.CleaningPlan.from_json(cleaning.measure_plan(batch, X.RUN_ALL).to_json())
    query = stream.write_clean(stream.clean_stream(stream.read_files(s, source, batch.schema), plan), path, f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.parquet(path)


QUERIES["stream_frozen_plan"] = streamed_clean
from checks.cleaning import FINAL  # noqa: E402

ORACLES["stream_frozen_plan"] = "SELECT " + ", ".join(f"{FINAL[c]} AS {c}" for c in ["order_id", "status", "discount_text", "is_urgent", "amount_inr"]) + f" FROM ({dirty_orders_sql()})"


def streamed_quality(s, d):
    """Windows are written once the watermark has passed them, and their state goes."""
    events = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    source, path = folder(s), folder(s)
    events.write.parquet(source)
    windows = stream.windowed_quality(stream.read_files(s, source, events.schema), "ts", {"low_values": "value < 10", "errors": "event_type = 'error'"})
    query = stream.write_clean(windows, path, f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.schema(windows.schema).parquet(path)


QUERIES["stream_windowed_quality"] = streamed_quality
ORACLES["stream_windowed_quality"] = """SELECT date_trunc('day', ts) AS window_start, count(*) AS "rows", count(*) FILTER (WHERE value < 10) AS low_values, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1
HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
