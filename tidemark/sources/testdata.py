"""Canonical series views over the driver's parquet tables.

Every view is derived by Spark from the given tables, so its work grows with
them.  Each view has a DuckDB twin (``VIEW_SQL``) used by the oracle queries.

* ``daily``  -- order value per priority and calendar day (5 series, gappy)
* ``ship``   -- shipped line value per return flag and ship day
* ``supplier_daily`` -- shipped quantity per supplier and day; the number of
  series grows with the scale factor (one per supplier)
* ``hourly`` -- total event value per event type and hour (TIMESTAMP series)
* ``updates`` -- a later batch for ``daily``: the partly shipped orders of each date, value * 1.01
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("series_id"),
                      F.to_date("o_orderdate").alias("ts"))
            .agg(F.sum("o_totalprice").alias("value")))


def ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_returnflag").alias("series_id"),
                       F.to_date("l_shipdate").alias("ts"))
            .agg(F.sum("l_extendedprice").alias("value")))


def supplier_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("series_id"),
                       F.to_date("l_shipdate").alias("ts"))
            .agg(F.sum("l_quantity").alias("value")))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("event_type").alias("series_id"),
                       F.date_trunc("hour", F.col("ts")).alias("ts"))
            .agg(F.sum("value").alias("value")))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P")
    return (o.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("ts"))
            .agg((F.sum("o_totalprice") * 1.01).alias("value")))


VIEW_SQL = {
    "daily": ("SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ts, "
              "SUM(o_totalprice) AS value FROM orders GROUP BY 1, 2"),
    "ship": ("SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS ts, "
             "SUM(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2"),
    "supplier_daily": ("SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS ts, "
                       "SUM(l_quantity) AS value FROM lineitem GROUP BY 1, 2"),
    "hourly": ("SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, "
               "SUM(value) AS value FROM events GROUP BY 1, 2"),
}
VIEW_SQL["updates"] = ("SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ts, "
                       "SUM(o_totalprice) * 1.01 AS value FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2")


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs defining the named views."""
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    return f"WITH {ctes}\n{sql}" if names else sql
