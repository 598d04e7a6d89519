"""Incremental strategies over orders, lineitem and events.

State and increment are cut by date, as in real loads; together they cover the
whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.operators import incremental as inc
from tablecraft.operators import keyindex
from tablecraft.operators.layout import Layout, time_partition
from tablecraft.sources.warehouse import Warehouse
from tablecraft.suite.models import project
from tablecraft.suite.registry import query, table


def at(text):
    return F.lit(text).cast("timestamp_ntz")


@query("inc_predicate", "SELECT event_id, ts, user_id, event_type, value FROM events")
def inc_predicate(spark, sf_dir):
    """The first run loads 20 days, the second only what is newer than that."""
    made = project(spark, sf_dir, until="2024-01-21")

    @made.model(
        materialized="incremental", unique_key="event_id", incremental_strategy="append",
        partition_by={"field": "ts", "data_type": "datetime"},
    )
    def all_events(ctx):
        rows = ctx.source("raw", "events").where(F.col("ts") < at(ctx.var_value("until")))
        if ctx.is_incremental:
            rows = ctx.newer(rows, "ts")
        return rows.select("event_id", "ts", "user_id", "event_type", "value")

    made.run("all_events")
    made.vars["until"] = "2025-01-01"
    made.run("all_events")
    return made.read("all_events")


@query(
    "inc_merge",
    """
    SELECT o_orderkey, o_custkey, o_orderdate,
           CASE WHEN o_orderdate >= TIMESTAMP '1999-07-01' THEN 'M' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderdate >= TIMESTAMP '1999-07-01' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice
    FROM orders
    """,
)
def inc_merge(spark, sf_dir):
    """Half a year of stored orders is updated, newer ones are inserted."""
    columns = ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice"]
    orders = table(spark, sf_dir, "orders").select(*columns)
    warehouse = Warehouse(spark)
    stored = orders.where(F.col("o_orderdate") < at("2000-01-01"))
    warehouse.create("orders", stored, Layout(rules=(time_partition("o_orderdate", "MONTH"),)))
    increment = orders.where(F.col("o_orderdate") >= at("1999-07-01")).withColumns(
        {"o_orderstatus": F.lit("M"), "o_totalprice": F.col("o_totalprice") * 2}
    )
    inc.merge(warehouse, "orders", increment, "o_orderkey")
    return warehouse.read("orders")


@query(
    "inc_merge_composite",
    """
    WITH old AS (
      SELECT l_orderkey, l_linenumber, SUM(CAST(l_quantity AS BIGINT)) AS quantity, COUNT(*) AS lines FROM lineitem
      WHERE l_shipdate < TIMESTAMP '2000-01-01' GROUP BY 1, 2),
    new AS (
      SELECT l_orderkey, l_linenumber, SUM(CAST(l_quantity AS BIGINT)) AS quantity, COUNT(*) AS lines FROM lineitem
      WHERE l_shipdate >= TIMESTAMP '1999-07-01' GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, CAST(quantity AS BIGINT) AS quantity, lines FROM new
    UNION ALL
    SELECT l_orderkey, l_linenumber, CAST(quantity AS BIGINT) AS quantity, lines FROM old
    WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.l_orderkey = old.l_orderkey AND new.l_linenumber = old.l_linenumber)
    """,
)
def inc_merge_composite(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")

    def lines(rows):
        return rows.groupBy("l_orderkey", "l_linenumber").agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.count(F.lit(1)).alias("lines")
        )

    warehouse = Warehouse(spark)
    warehouse.create("lines", lines(lineitem.where(F.col("l_shipdate") < at("2000-01-01"))))
    inc.merge(
        warehouse, "lines", lines(lineitem.where(F.col("l_shipdate") >= at("1999-07-01"))), ["l_orderkey", "l_linenumber"]
    )
    return warehouse.read("lines")


@query("inc_insert_only", "SELECT DISTINCT user_id, event_type FROM events")
def inc_insert_only(spark, sf_dir):
    """All columns are keys: known pairs stay, new ones are added."""
    pairs = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    warehouse = Warehouse(spark)
    warehouse.create("pairs", pairs.where(F.col("ts") < at("2024-01-04")).select("user_id", "event_type").distinct())
    increment = pairs.where(F.col("ts") >= at("2024-01-03")).select("user_id", "event_type").distinct()
    inc.insert_only(warehouse, "pairs", increment, ["user_id", "event_type"])
    return warehouse.read("pairs")


@query(
    "inc_delete_insert",
    """
    WITH src AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-12-01')
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM src
    UNION ALL
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM lineitem
    WHERE l_shipdate < TIMESTAMP '2000-01-01' AND l_orderkey NOT IN (SELECT l_orderkey FROM src)
    """,
)
def inc_delete_insert(spark, sf_dir):
    """Orders shipped since December lose their stored lines; duplicates stay."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate"]
    lineitem = table(spark, sf_dir, "lineitem").select(*columns)
    warehouse = Warehouse(spark)
    stored = lineitem.where(F.col("l_shipdate") < at("2000-01-01"))
    warehouse.create("lines", stored, Layout(rules=(time_partition("l_shipdate", "MONTH"),)))
    inc.delete_insert(warehouse, "lines", lineitem.where(F.col("l_shipdate") >= at("1999-12-01")), "l_orderkey")
    return warehouse.read("lines")


@query(
    "inc_append",
    """
    SELECT event_id, ts, event_type FROM events WHERE ts < TIMESTAMP '2024-01-20'
    UNION ALL SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10'
    """,
)
def inc_append(spark, sf_dir):
    """Two loads overlap by ten days; append keeps both copies."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    warehouse = Warehouse(spark)
    warehouse.create("events", events.where(F.col("ts") < at("2024-01-20")))
    inc.append(warehouse, "events", events.where(F.col("ts") >= at("2024-01-10")))
    return warehouse.read("events")


@query(
    "inc_key_index",
    """
    SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 97 IN (1, 2) THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderkey % 97 = 2 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice
    FROM orders
    """,
)
def inc_key_index(spark, sf_dir):
    """Orders stored by month of their date; keys scattered over all months are merged, then replaced, by the key index."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    warehouse = Warehouse(spark)
    warehouse.create("orders", orders.where("o_orderkey % 97 <> 1"), Layout(rules=(time_partition("o_orderdate", "MONTH"),)))
    keyindex.index_keys(warehouse, "orders", "o_orderkey")
    changed = orders.where("o_orderkey % 97 IN (1, 2)").withColumn("o_orderstatus", F.lit("X"))
    inc.merge(warehouse, "orders", changed, "o_orderkey")
    inc.delete_insert(warehouse, "orders", changed.where("o_orderkey % 97 = 2").withColumn("o_totalprice", -F.col("o_totalprice")), "o_orderkey")
    return warehouse.read("orders")
