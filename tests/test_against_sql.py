"""Registered queries against their SQL on the smallest shared tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables absent")
SAMPLE = ["p1_overview", "p6_iqr_outliers", "p8_top_values_long_text", "p13_correlation_pairs", "q8_quality_score", "t10_rank_threats",
          "r6_detect_sector", "n15_report_facts", "n16_histograms", "c13_run_all", "x10_apply_corrections", "x13_case_variant_merges", "l_apply_plan",
          "i11_winsorize", "i12_forward_fill", "m5_forecast", "m6_moving_average", "g2_chunk_documents", "g7_delta_ingest", "g10_context_assembly",
          "k2_rolling_median_filter", "k14_distribution_drift", "k22_basket_pairs", "s4_read_json_payload", "stream_frozen_plan"]


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, database, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = database.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
