"""The driver's tables as interval frames, in DataFrames and in SQL.

``items``: every line item, in days, grouped by supplier;
``parts``: the same grouped by part; ``orders``: in days, grouped by customer
modulo the number of suppliers; ``events``: in seconds, grouped by user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.intervals import as_intervals, read_intervals


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_intervals(spark, f"{sf_dir}/{name}.parquet")


def _day(c: str) -> Column:
    return F.datediff(F.col(c), F.lit("1970-01-01")).cast("long")


#: The columns that tell line items of one order and line number apart, in the order that numbers them.
_APART = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
#: Rows repeated under one order and line number at most: ids leave room for so many, and the number is never reached in practice.
_ROOM = 1009


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item with a unique ``idx``: order and line number are not unique, so rows are numbered within them."""
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*_APART)
    idx = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * _ROOM + F.row_number().over(order) - 1
    return _table(spark, sf_dir, "lineitem").select(
        idx.cast("long").alias("idx"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_partkey").alias("part"),
        _day("l_shipdate").alias("day"),
        F.floor("l_quantity").cast("long").alias("quantity"),
        F.col("l_linestatus").alias("status"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_intervals(_lines(spark, sf_dir), "idx", "day", F.col("day") + F.col("quantity"), F.col("supp"), F.col("status") == "O")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_intervals(_lines(spark, sf_dir), "idx", "day", F.col("day") + F.col("quantity"), F.col("part"), F.col("part") % 2 == 0)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _table(spark, sf_dir, "supplier").agg(F.count("*").alias("n_supp"))
    rows = _table(spark, sf_dir, "orders").crossJoin(F.broadcast(suppliers))  # one row
    start = _day("o_orderdate")
    return as_intervals(rows, "o_orderkey", start, start + 7 + F.col("o_orderkey") % 60, F.col("o_custkey") % F.col("n_supp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return as_intervals(rows, "event_id", start, start + F.floor("value").cast("long") + 1, "user_id", F.col("event_type") == "error")


#: The same views for DuckDB, as common table expressions.
SQL = {
    "lines": f"""lines AS (
        SELECT CAST((l_orderkey * 8 + l_linenumber) * {_ROOM} - 1 + row_number() OVER (
                   PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_APART)}) AS BIGINT) AS idx,
               l_suppkey AS supp, l_partkey AS part, CAST(datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day,
               CAST(floor(l_quantity) AS BIGINT) AS quantity, l_linestatus AS status FROM lineitem)""",
    "items": """items AS (SELECT idx, supp AS grp, day AS s, day + quantity AS e, status = 'O' AS fwd FROM lines)""",
    "parts": """parts AS (SELECT idx, part AS grp, day AS s, day + quantity AS e, part % 2 = 0 AS fwd FROM lines)""",
    "ord": """ord AS (
        SELECT o_orderkey AS idx, o_custkey % (SELECT count(*) FROM supplier) AS grp,
               CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s,
               CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 7 + o_orderkey % 60 AS BIGINT) AS e FROM orders)""",
    "ev": """ev AS (
        SELECT event_id AS idx, user_id AS grp, CAST(floor(epoch(ts)) AS BIGINT) AS s,
               CAST(floor(epoch(ts)) + floor(value) + 1 AS BIGINT) AS e, event_type = 'error' AS fwd FROM events)""",
}
