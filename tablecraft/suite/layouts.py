"""Partitioning, clustering, retention and collation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tablecraft.operators.layout import (
    Layout, collate, date_partition, expire_partitions, range_partition, scan, time_partition,
)
from tablecraft.sources.warehouse import Warehouse
from tablecraft.suite.registry import query, table


@query(
    "part_date",
    """
    SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_day, event_type, value FROM events
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-16'
    """,
)
def part_date(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("date").alias("event_day"), "event_type", "value"
    )
    warehouse = Warehouse(spark)
    warehouse.create("events", events, Layout(rules=(date_partition("event_day"),)))
    slice_ = scan(warehouse, "events", [("event_day", "between", (dt.date(2024, 1, 10), dt.date(2024, 1, 15)))])
    return slice_.withColumn("event_day", F.col("event_day").cast("string"))


@query(
    "part_ts_trunc",
    """
    SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-05-01' AND l_shipdate < TIMESTAMP '1997-06-01'
    """,
)
def part_ts_trunc(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    warehouse = Warehouse(spark)
    warehouse.create("lines", lines, Layout(rules=(time_partition("l_shipdate", "MONTH"),)))
    return scan(
        warehouse, "lines",
        [("l_shipdate", ">=", dt.datetime(1997, 5, 1)), ("l_shipdate", "<", dt.datetime(1997, 6, 1))],
    )


@query("part_int_range", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey >= 40 AND o_custkey < 90")
def part_int_range(spark, sf_dir):
    """Customers 0-999 in steps of 50; higher keys share the overflow directory."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    warehouse = Warehouse(spark)
    warehouse.create("orders", orders, Layout(rules=(range_partition("o_custkey", 0, 1000, 50),)))
    return scan(warehouse, "orders", [("o_custkey", ">=", 40), ("o_custkey", "<", 90)])


@query("cluster_by", "SELECT l_suppkey, l_partkey, l_orderkey, l_quantity FROM lineitem WHERE l_suppkey BETWEEN 3 AND 7")
def cluster_by(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_quantity")
    warehouse = Warehouse(spark)
    warehouse.create("lines", lines, Layout(cluster_by=("l_suppkey", "l_partkey")))
    return scan(warehouse, "lines", [("l_suppkey", "between", (3, 7))])


@query("cluster_curve", "SELECT l_suppkey, l_partkey, l_orderkey, l_quantity FROM lineitem WHERE l_partkey BETWEEN 100 AND 150")
def cluster_curve(spark, sf_dir):
    """Stored along a curve through two columns, filtered by the second."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_quantity")
    warehouse = Warehouse(spark)
    warehouse.create("lines", lines, Layout(cluster_by=("l_suppkey", "l_partkey"), curve=True))
    return scan(warehouse, "lines", [("l_partkey", "between", (100, 150))])


@query(
    "require_part_filter",
    "SELECT event_type, COUNT(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY 1",
)
def require_part_filter(spark, sf_dir):
    warehouse = Warehouse(spark)
    layout = Layout(rules=(time_partition("ts", "DAY"),), require_filter=True)
    warehouse.create("events", table(spark, sf_dir, "events"), layout)
    recent = scan(warehouse, "events", [("ts", ">=", dt.datetime(2024, 1, 25))])
    return recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("expire_partitions", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01'")
def expire(spark, sf_dir):
    """Monthly directories; 30 days before 15 July 1999 is 15 June, so June stays."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    warehouse = Warehouse(spark)
    layout = Layout(rules=(time_partition("o_orderdate", "MONTH"),), partition_expiration_days=30)
    warehouse.create("orders", orders, layout)
    expire_partitions(warehouse, "orders", dt.datetime(1999, 7, 15))
    return warehouse.read("orders")


@query("collated_group", "SELECT lower(c_mktsegment) AS segment, COUNT(*) AS customers FROM customer GROUP BY 1")
def collated_group(spark, sf_dir):
    """Segments spelled in mixed case are one group under a case-blind collation."""
    mixed = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 2000, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    warehouse = Warehouse(spark)
    warehouse.create("customers", collate(mixed, "und:ci", ["segment"]))
    grouped = warehouse.read("customers").groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))
    return grouped.select(F.lower(F.collate("segment", "UTF8_BINARY")).alias("segment"), "customers")
