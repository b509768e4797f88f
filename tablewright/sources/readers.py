"""Reading tables: files, databases, JSON payloads and paged filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import col
from tablewright.sources.quoted_csv import ENCODINGS, read_quoted_csv

# Keys a JSON envelope may hold its rows under, in order of preference.
ENVELOPE_KEYS = ["records", "data", "rows", "results", "items"]


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """CSV with a header. Without a schema, types are inferred, which costs one more scan.

    Quoted values may hold line ends, as those that ``write_csv`` makes do. With a schema a file is read by many tasks all the same; only where types
    are inferred is it read by one. Files without such values read in pieces with ``multi_line`` off.
    """
    if schema is not None and multi_line and encoding.upper() in ENCODINGS:
        return read_quoted_csv(spark, path, schema, encoding)
    reader = spark.read.option("header", True).option("encoding", encoding).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_csv_any_encoding(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV as UTF-8, or as Latin-1 when any text does not decode.

    The text reader keeps bytes as they are, so one filtered look decides; it stops at the
    first line that is not valid UTF-8.
    """
    raw = spark.read.text(path)
    if raw.filter(~F.is_valid_utf8("value")).limit(1).count():
        return read_csv(spark, path, schema, "ISO-8859-1")
    return read_csv(spark, path, schema)


def statement(query: str | None = None, table: str | None = None) -> str:
    """What a database is asked: a query, or every column of a named table. Exactly one of them is given."""
    if (query is None) == (table is None):
        raise ValueError("give a query or a table")
    return query.strip().rstrip(";") if table is None else f"SELECT * FROM {table}"


def read_sql(spark: SparkSession, url: str, query: str | None = None, table: str | None = None, limit: int | None = None, properties: dict | None = None,
             partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 64) -> DataFrame:
    """A database query over JDBC. With a partition column and its bounds, the read is split into range queries.

    The row limit is Spark's, over the whole result, so it holds however many queries the read is split into; Spark passes
    it on to the database where that is safe.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**(properties or {}))
    asked = statement(query, table)
    if partition_column and bounds:
        found = (reader.option("dbtable", f"({asked}) AS asked").option("partitionColumn", partition_column)
                 .option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions).load())
    else:
        found = reader.option("query", asked).load()
    return found if limit is None else found.limit(limit)


def read_catalog_sql(spark: SparkSession, query: str | None = None, table: str | None = None, limit: int | None = None) -> DataFrame:
    """The same over tables and views the session knows."""
    found = spark.sql(statement(query, table))
    return found if limit is None else found.limit(limit)


def payload_rows(df: DataFrame, payload: str, row_schema: str, keep: list[str] | None = None) -> DataFrame:
    """Rows of JSON payloads: a top-level list, else the first list under a known key, else the object itself.

    Payloads that are not JSON give no row here; ``malformed_payloads`` lists them.
    """
    df = df.filter(F.try_parse_json(col(payload)).isNotNull())
    text = col(payload)
    listed = F.from_json(text, f"array<struct<{row_schema}>>")
    envelope = F.from_json(text, ", ".join(f"`{k}` array<struct<{row_schema}>>" for k in ENVELOPE_KEYS))
    single = F.array(F.from_json(text, f"struct<{row_schema}>"))
    is_list = F.ltrim(text).startswith("[")
    rows = F.when(is_list, listed).otherwise(F.coalesce(*[envelope[k] for k in ENVELOPE_KEYS], single))
    return df.select(*[col(c) for c in keep or []], F.explode(rows).alias("row")).select(*[col(c) for c in keep or []], "row.*")


def malformed_payloads(df: DataFrame, payload: str, keep: list[str] | None = None) -> DataFrame:
    """The payloads that start like JSON but are not, whole."""
    start = F.substring(F.ltrim(col(payload)), 1, 1)
    return df.filter(start.isin("[", "{") & F.try_parse_json(col(payload)).isNull()).select(*[col(c) for c in keep or []], col(payload))


def payload_table(df: DataFrame, payload: str, csv_schema: str, row_schema: str, keep: list[str] | None = None) -> DataFrame:
    """JSON payload rows, and one CSV record per line of payloads that are not JSON (header skipped)."""
    start = F.substring(F.ltrim(col(payload)), 1, 1)
    as_json = df.filter(start.isin("[", "{"))
    as_text = df.filter(~start.isin("[", "{"))
    lines = as_text.select(*[col(c) for c in keep or []], F.posexplode(F.split(col(payload), r"\r?\n")).alias("line", "text")).filter("line > 0 AND trim(text) <> ''")
    records = lines.select(*[col(c) for c in keep or []], F.from_csv("text", csv_schema).alias("row")).select(*[col(c) for c in keep or []], "row.*")
    return payload_rows(as_json, payload, row_schema, keep).unionByName(records)


def filtered_page(df: DataFrame, filters: dict[str, object], order_by: list[str], limit: int = 1000, offset: int = 0) -> DataFrame:
    """Equality filters, which reach the file scan, then one page in a stated order."""
    out = df
    for name, value in filters.items():
        out = out.filter(col(name) == F.lit(value))
    return out.orderBy(*[col(c) for c in order_by]).offset(offset).limit(limit)
