"""Snapshots: customers who ordered in the last four years, as seen at three times.

Between two times customers appear, change (a newer order) and vanish (none in
four years). The windows of the first two times cover all orders.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tablecraft.operators import snapshot as scd
from tablecraft.operators.layout import scan
from tablecraft.sources.warehouse import Warehouse
from tablecraft.suite.registry import query, table

TIMES = ("1998-01-01", "2001-09-01", "2002-03-01")
YEARS = 4
KEY, UPDATED = "cust", "updated_at"


def clock(n):
    return dt.datetime.fromisoformat(TIMES[n])


def active_customers(spark, sf_dir, n):
    until = F.lit(TIMES[n]).cast("timestamp_ntz")
    day = F.col("o_orderdate")
    year = F.timestamp_add("YEAR", F.lit(-YEARS), until)
    return (
        table(spark, sf_dir, "orders")
        .where((day > year) & (day <= until))
        .groupBy(F.col("o_custkey").alias(KEY))
        .agg(F.max("o_orderdate").alias(UPDATED), F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("top_price"))
    )


def all_customers(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias(KEY)).agg(
        F.max("o_orderdate").alias(UPDATED), F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("top_price"))


EVERY_CUSTOMER = "SELECT o_custkey AS cust, MAX(o_orderdate) AS updated_at, COUNT(*) AS n_orders, MAX(o_totalprice) AS top_price FROM orders GROUP BY o_custkey"


def sources(last):
    return ",\n".join(
        f"""s{n} AS (SELECT o_custkey AS cust, MAX(o_orderdate) AS updated_at, COUNT(*) AS n_orders,
        MAX(o_totalprice) AS top_price FROM orders
        WHERE o_orderdate > TIMESTAMP '{TIMES[n]}' - INTERVAL {YEARS} YEAR AND o_orderdate <= TIMESTAMP '{TIMES[n]}'
        GROUP BY o_custkey)"""
        for n in range(last + 1)
    )


def versioned(rows, n):
    return f"""SELECT r.*, md5(CAST(r.cust AS VARCHAR) || '|' || CAST(r.updated_at AS VARCHAR)) AS dbt_scd_id,
        r.updated_at AS dbt_updated_at, TIMESTAMP '{TIMES[n]}' AS dbt_valid_from,
        CAST(NULL AS TIMESTAMP) AS dbt_valid_to FROM ({rows}) r"""


def history(last, insert=True, hard=False):
    """CTEs h0..h<last> of the history after each run."""
    parts = [sources(last), f"h0 AS ({versioned('SELECT * FROM s0', 0)})"]
    for n in range(1, last + 1):
        gone = f"OR h.cust NOT IN (SELECT cust FROM s{n})" if hard else ""
        parts.append(
            f"""c{n} AS (SELECT h.* REPLACE (CASE WHEN h.dbt_valid_to IS NOT NULL THEN h.dbt_valid_to
            WHEN s.updated_at > h.dbt_updated_at {gone} THEN TIMESTAMP '{TIMES[n]}' END AS dbt_valid_to),
            h.dbt_valid_to IS NULL AND NOT coalesce(s.updated_at > h.dbt_updated_at, false) AS remains
            FROM h{n - 1} h LEFT JOIN s{n} s ON h.cust = s.cust)"""
        )
        fresh = f"SELECT * FROM s{n} WHERE cust NOT IN (SELECT cust FROM c{n} WHERE remains)"
        union = f"UNION ALL {versioned(fresh, n)}" if insert else ""
        parts.append(f"h{n} AS (SELECT * EXCLUDE (remains) FROM c{n} {union})")
    return "WITH " + ",\n".join(parts)


@query("scd_init", versioned(EVERY_CUSTOMER, 1))
def scd_init(spark, sf_dir):
    warehouse = Warehouse(spark)
    scd.snapshot_run(warehouse, "customers", all_customers(spark, sf_dir), KEY, UPDATED, clock(1))
    return warehouse.read("customers")


@query("scd_invalidate", f"{history(1, insert=False)} SELECT * FROM h1")
def scd_invalidate(spark, sf_dir):
    first = scd.snapshot_init(active_customers(spark, sf_dir, 0), KEY, UPDATED, clock(0))
    return scd.snapshot_close(first, active_customers(spark, sf_dir, 1), KEY, UPDATED, clock(1))


@query("scd_insert", f"{history(1)} SELECT * FROM h1")
def scd_insert(spark, sf_dir):
    first = scd.snapshot_init(active_customers(spark, sf_dir, 0), KEY, UPDATED, clock(0))
    return scd.snapshot_apply(first, active_customers(spark, sf_dir, 1), KEY, UPDATED, clock(1))


@query("scd_hard_delete", f"{history(1, hard=True)} SELECT * FROM h1")
def scd_hard_delete(spark, sf_dir):
    first = scd.snapshot_init(active_customers(spark, sf_dir, 0), KEY, UPDATED, clock(0))
    return scd.snapshot_apply(
        first, active_customers(spark, sf_dir, 1), KEY, UPDATED, clock(1), invalidate_hard_deletes=True
    )


def run_cycle(spark, sf_dir, **options):
    warehouse = Warehouse(spark)
    for n in range(3):
        scd.snapshot_run(
            warehouse, "customers", active_customers(spark, sf_dir, n), KEY, UPDATED, clock(n),
            invalidate_hard_deletes=True, **options,
        )
    return warehouse


@query("scd_cycle", f"{history(2, hard=True)} SELECT * FROM h2")
def scd_cycle(spark, sf_dir):
    return run_cycle(spark, sf_dir).read("customers")


@query(
    "scd_layout",
    f"""{history(2, hard=True)}
    SELECT dbt_valid_from, COUNT(*) AS versions, COUNT(dbt_valid_to) AS closed FROM h2
    WHERE dbt_valid_from >= TIMESTAMP '{TIMES[1]}' GROUP BY 1""",
)
def scd_layout(spark, sf_dir):
    """Recent versions only: older directories are pruned."""
    recent = scan(run_cycle(spark, sf_dir), "customers", [("dbt_valid_from", ">=", clock(1))])
    return recent.groupBy("dbt_valid_from").agg(
        F.count(F.lit(1)).alias("versions"), F.count("dbt_valid_to").alias("closed")
    )


@query(
    "scd_new_column",
    f"""{history(1)}
    SELECT h.cust, h.updated_at, h.n_orders, h.top_price,
           CASE WHEN h.dbt_valid_from = TIMESTAMP '{TIMES[1]}' THEN c.c_mktsegment END AS segment,
           h.dbt_scd_id, h.dbt_updated_at, h.dbt_valid_from, h.dbt_valid_to
    FROM h1 h LEFT JOIN customer c ON h.cust = c.c_custkey""",
)
def scd_new_column(spark, sf_dir):
    """The second source has one more column; old versions hold NULL there."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(KEY), F.col("c_mktsegment").alias("segment"))
    warehouse = Warehouse(spark)
    scd.snapshot_run(warehouse, "customers", active_customers(spark, sf_dir, 0), KEY, UPDATED, clock(0))
    wider = active_customers(spark, sf_dir, 1).join(customer, KEY, "left")
    scd.snapshot_run(warehouse, "customers", wider, KEY, UPDATED, clock(1))
    return warehouse.read("customers")


@query(
    "scd_id",
    "SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_orderdate AS VARCHAR)) AS version_id FROM orders",
)
def scd_id(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scd.scd_id("o_orderkey", "o_orderdate").alias("version_id"))


@query("scd_digests", f"{history(2, hard=True)} SELECT * FROM h2")
def scd_digests(spark, sf_dir):
    """The cycle with hard deletes by digests, every extract seen twice: the second time there is nothing to join."""
    warehouse = Warehouse(spark)
    for n in range(3):
        for _ in range(2):
            scd.snapshot_run(
                warehouse, "customers", active_customers(spark, sf_dir, n), KEY, UPDATED, clock(n), invalidate_hard_deletes=True, digests=True)
    return warehouse.read("customers")
