"""Inputs shared by the checks: plain tables and dirty views derived from them.

A dirty view is a projection of a whole table, written once in SQL that Spark and other
engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(number: str) -> str:
    return f"cast({number} AS STRING)"


def padded(number: str, width: int) -> str:
    return f"lpad({text_of(number)}, {width}, '0')"


_YEAR = text_of("year(o_orderdate)")
_MONTH = "month(o_orderdate)"
_DAY = "day(o_orderdate)"
_NAME = f"substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * {_MONTH} - 2, 3)"
K = "o_orderkey"

DIRTY_ORDERS = {
    "order_id": K,
    "customer_ref": "CASE WHEN o_custkey % 33 = 0 THEN NULL ELSE concat('CUST-', " + text_of("o_custkey") + ") END",
    "status": f"CASE WHEN {K} % 23 = 0 THEN 'N/A' WHEN {K} % 29 = 0 THEN ' unknown ' "
              f"WHEN {K} % 3 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END",
    "priority": f"CASE WHEN {K} % 7 = 0 THEN concat(' ', o_orderpriority, '  ') "
                f"WHEN {K} % 11 = 0 THEN concat(o_orderpriority, '​') "
                f"WHEN {K} % 13 = 0 THEN concat('9 ', o_orderpriority, '\t', 'x  y') ELSE o_orderpriority END",
    "total_amount": f"CASE WHEN {K} % 9 = 0 THEN NULL ELSE o_totalprice END",
    "price_text": f"CASE WHEN {K} % 31 = 0 THEN 'missing' ELSE concat('$', "
                  + text_of("cast(floor(o_totalprice / 1000) AS BIGINT)") + ", ',', "
                  + padded("cast(floor(o_totalprice) AS BIGINT) % 1000", 3) + ") END",
    "discount_text": f"CASE WHEN {K} % 5 = 0 THEN 'N/A' ELSE concat({text_of(K + ' % 100')}, '.5%') END",
    "is_urgent": f"CASE WHEN o_orderpriority LIKE '1%' THEN 'Yes' WHEN {K} % 13 = 0 THEN 'maybe' ELSE 'NO' END",
    "order_year": f"CASE WHEN {K} % 4 = 0 THEN {text_of('year(o_orderdate) % 100')} "
                  f"WHEN {K} % 4 = 1 THEN concat({_YEAR}, '.0') ELSE {_YEAR} END",
    "contact_phone": f"CASE {K} % 3 WHEN 0 THEN concat('(555) ', {padded(K + ' % 1000', 3)}, '-', {padded(K + ' % 10000', 4)}) "
                     f"WHEN 1 THEN concat('+1-555-', {padded(K + ' % 1000', 3)}, '-', {padded(K + ' % 10000', 4)}) "
                     f"ELSE concat('555.', {padded(K + ' % 1000', 3)}, '.', {padded(K + ' % 10000', 4)}) END",
    "email": f"CASE {K} % 4 WHEN 0 THEN concat('User', {text_of(K)}, '@GMIAL.COM') "
             f"WHEN 1 THEN concat(' user', {text_of(K)}, '@yahoo.com') "
             f"WHEN 2 THEN concat('a.', {text_of(K)}, '@gmail.co') ELSE concat('b', {text_of(K)}, '@mail.example.org') END",
    "amount_inr": f"concat({text_of('1 + ' + K + ' % 9')}, ',', {padded(K + ' % 100', 2)}, ',', {padded(K + ' % 1000', 3)})",
    "delta": f"CASE WHEN {K} % 6 = 0 THEN concat('(', {text_of('100 + ' + K + ' % 900')}, '.50)') ELSE {text_of(K + ' % 700')} END",
    "author": f"CASE WHEN {K} % 5 = 0 THEN o_orderpriority WHEN {K} % 5 = 1 THEN concat('Written by: ', o_orderpriority) "
              f"ELSE concat('narratedby:', o_orderpriority) END",
    "rating": f"CASE WHEN {K} % 10 = 0 THEN 'Not rated yet' ELSE concat({text_of('1 + ' + K + ' % 5')}, "
              f"'.5 out of 5 stars ', {text_of(K + ' % 100')}, ' ratings') END",
    "order_date": f"CASE {K} % 6 WHEN 0 THEN concat({_YEAR}, '-', {padded(_MONTH, 2)}, '-', {padded(_DAY, 2)}) "
                  f"WHEN 1 THEN concat({padded(_MONTH, 2)}, '/', {padded(_DAY, 2)}, '/', {_YEAR}) "
                  f"WHEN 2 THEN concat({text_of(_DAY)}, '.', {text_of(_MONTH)}, '.', {_YEAR}) "
                  f"WHEN 3 THEN concat({_NAME}, ' ', {text_of(_DAY)}, ', ', {_YEAR}) "
                  f"WHEN 4 THEN concat({text_of(_MONTH)}, '-', {text_of(_DAY)}, '-', {_YEAR}) ELSE 'soon' END",
    "note": f"CASE {K} % 8 WHEN 0 THEN 'donâ€™t wait[1]' WHEN 1 THEN 'cafÃ© order [2][b]' "
            f"WHEN 2 THEN 'cost Â£5 naÃ¶ve' ELSE concat('plain note ', {text_of(K + ' % 20')}) END",
    "city": f"CASE {K} % 16 WHEN 0 THEN 'New York' WHEN 1 THEN 'new york' WHEN 2 THEN 'NEW YORK ' WHEN 3 THEN 'New Yorkk' "
            f"WHEN 4 THEN 'Acme Inc' WHEN 5 THEN 'The Acme' WHEN 6 THEN 'Chicago' WHEN 7 THEN 'Chicago' WHEN 8 THEN 'Chcago' "
            f"WHEN 9 THEN 'York New' WHEN 10 THEN 'San Francisco' WHEN 11 THEN 'san francisco' WHEN 12 THEN 'San Fransisco' "
            f"WHEN 13 THEN 'Boston' WHEN 14 THEN 'Austin' ELSE 'Denver' END",
    "mixed_number": f"CASE {K} % 3 WHEN 0 THEN concat('1,', {padded(K + ' % 1000', 3)}, '.50') "
                    f"WHEN 1 THEN concat('2.', {padded(K + ' % 1000', 3)}, ',25') ELSE {text_of(K + ' % 500')} END",
    "quantity_text": f"concat({text_of('1 + ' + K + ' % 9')}, ',', {padded(K + ' % 1000', 3)})",
    "reference": "CAST(NULL AS STRING)",
}


def dirty_orders(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    wanted = columns or DIRTY_ORDERS
    return table(spark, folder, "orders").selectExpr(*[f"{DIRTY_ORDERS[c]} AS {c}" for c in wanted])


def dirty_orders_sql(*columns: str) -> str:
    wanted = columns or DIRTY_ORDERS
    return "SELECT " + ", ".join(f"{DIRTY_ORDERS[c]} AS {c}" for c in wanted) + " FROM orders"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
AS_OF = "2024-06-30"
