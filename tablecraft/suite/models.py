"""Models, references, materializations, variables, macros and jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tablecraft.functions.builtins import cents_to_dollars, macro
from tablecraft.functions.jobs import run_script, run_sql
from tablecraft.operators import aggregates
from tablecraft.operators import incremental as inc
from tablecraft.operators.aggregates import Aggregate
from tablecraft.operators.layout import Layout, time_partition
from tablecraft.plans.project import Project, replace_contents
from tablecraft.sources.warehouse import Warehouse
from tablecraft.suite.registry import query, table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "conversations",
)


def project(spark, sf_dir, **variables) -> Project:
    """A project whose source ``raw`` is the folder of test tables."""
    paths = {t: f"{sf_dir}/{t}.parquet" for t in TABLES}
    return Project(spark, Warehouse(spark), sources={"raw": paths}, vars=variables)


DAILY_REVENUE = """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
       r_name AS region,
       CAST(SUM(CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 2) AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
       COUNT(*) AS order_count
FROM orders
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
GROUP BY 1, 2
"""


def daily_revenue_frame(orders, customer, nation, region):
    """Revenue and order count per day and region, exact to the cent.

    The dimensions join first, so orders meet one narrow side and are then
    summed per (day, region) before the aggregation's shuffle.
    """
    places = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("r_name").alias("region"))
    )
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    sales = orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), cents.alias("amount_cents"))
    return (
        sales.join(places, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("day", "region")
        .agg(F.sum(cents_to_dollars("amount_cents")).alias("revenue"), F.count(F.lit(1)).alias("order_count"))
    )


@query("daily_revenue", DAILY_REVENUE)
def daily_revenue(spark, sf_dir):
    made = project(spark, sf_dir)

    @made.model(materialized="table", description="Revenue per day and region")
    def daily_revenue(ctx):
        return daily_revenue_frame(*[ctx.source("raw", t) for t in ("orders", "customer", "nation", "region")])

    made.run("daily_revenue")
    return made.read("daily_revenue").select(
        F.col("day").cast("string").alias("day"), "region", F.col("revenue").cast("double").alias("revenue"), "order_count"
    )


@query("source_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def source_scan(spark, sf_dir):
    raw = project(spark, sf_dir).source("raw", "customer")
    return raw.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name", "c_acctbal")


@query("ref_scan", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal > 0")
def ref_scan(spark, sf_dir):
    made = project(spark, sf_dir)

    @made.model(materialized="table")
    def stg_customer(ctx):
        return ctx.source("raw", "customer").where(F.col("c_mktsegment") != "BUILDING")

    @made.model(materialized="ephemeral")
    def in_credit(ctx):
        return ctx.ref("stg_customer").where(F.col("c_acctbal") > 0).select("c_custkey", "c_acctbal")

    made.run("stg_customer")
    return made.read("in_credit")


@query("mat_table", "SELECT c_nationkey, COUNT(*) AS customers, MAX(c_acctbal) AS top_balance FROM customer GROUP BY 1")
def mat_table(spark, sf_dir):
    made = project(spark, sf_dir)

    @made.model(
        materialized="table", cluster_by="c_nationkey", description="Customers per nation", labels={"team": "sales"}
    )
    def nation_customers(ctx):
        return ctx.source("raw", "customer").groupBy("c_nationkey").agg(
            F.count(F.lit(1)).alias("customers"), F.max("c_acctbal").alias("top_balance")
        )

    made.run("nation_customers")
    return made.read("nation_customers")


@query("mat_view", "SELECT c_mktsegment, COUNT(*) AS customers FROM customer WHERE c_acctbal < 0 GROUP BY 1")
def mat_view(spark, sf_dir):
    made = project(spark, sf_dir)

    @made.model(materialized="view")
    def overdrawn(ctx):
        return ctx.sql(
            "SELECT c_mktsegment, COUNT(*) AS customers FROM {customer} WHERE c_acctbal < 0 GROUP BY c_mktsegment",
            customer=ctx.source("raw", "customer"),
        )

    made.run("overdrawn")
    return spark.table("overdrawn")


@query("mat_mv_refresh", "SELECT o_orderstatus, COUNT(*) AS orders, MAX(o_totalprice) AS top_price FROM orders GROUP BY 1")
def mat_mv_refresh(spark, sf_dir):
    """Built on the orders before 1998, then refreshed over all of them."""
    start = dt.datetime(2024, 1, 1)
    made = project(spark, sf_dir)
    orders = made.source("raw", "orders")
    made.warehouse.create("stg_orders", orders.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")))

    @made.model(materialized="materialized_view", enable_refresh=True, refresh_interval_minutes=60)
    def status_totals(ctx):
        return ctx.ref("stg_orders").groupBy("o_orderstatus").agg(
            F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("top_price")
        )

    @made.model(materialized="table", owns_table=False)
    def stg_orders(ctx):
        return ctx.source("raw", "orders")

    made.refresh_if_stale("status_totals", start)
    made.warehouse.append("stg_orders", orders.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")))
    if made.refresh_if_stale("status_totals", start + dt.timedelta(minutes=59)):
        raise AssertionError("refreshed before the interval was over")
    made.refresh_if_stale("status_totals", start + dt.timedelta(minutes=61))
    return made.read("status_totals")


@query(
    "mat_mv_delta",
    """
    WITH changed AS (
      SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, o_orderdate,
             CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END * CAST(o_totalprice AS DECIMAL(18, 2)) AS price
      FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
    SELECT o_orderstatus, o_orderpriority, COUNT(*) AS orders, SUM(CAST(price AS DECIMAL(18, 2))) AS revenue,
           MIN(CAST(price AS DECIMAL(18, 2))) AS lowest, MAX(CAST(price AS DECIMAL(18, 2))) AS highest, MAX(o_orderdate) AS latest
    FROM changed GROUP BY 1, 2
    """,
)
def mat_mv_delta(spark, sf_dir):
    """A view over orders by month, refreshed after an append, a merge, a delete+insert and the expiry of a year."""
    start = dt.datetime(2024, 1, 1)
    made = project(spark, sf_dir)
    price = F.col("o_totalprice").cast("decimal(18,2)")
    orders = made.source("raw", "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", price.alias("price"))
    before = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    made.warehouse.create("orders_kept", orders.where(before), Layout(rules=(time_partition("o_orderdate", "YEAR"),)))
    made.aggregate_view("status_totals", Aggregate(
        "orders_kept", {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"},
        {"orders": aggregates.count(), "revenue": aggregates.total("price"), "lowest": aggregates.least("price"),
         "highest": aggregates.greatest("price"), "latest": aggregates.greatest("o_orderdate")}), enable_refresh=True, refresh_interval_minutes=60)
    made.refresh_if_stale("status_totals", start)

    made.warehouse.append("orders_kept", orders.where(~before))
    made.refresh_if_stale("status_totals", start + dt.timedelta(hours=2))
    doubled = orders.where("o_orderkey % 7 = 0").withColumn("price", (F.col("price") * 2).cast("decimal(18,2)"))
    inc.merge(made.warehouse, "orders_kept", doubled, "o_orderkey")
    made.refresh_if_stale("status_totals", start + dt.timedelta(hours=4))
    pending = made.warehouse.read("orders_kept").where("o_orderkey % 11 = 0").withColumn("o_orderstatus", F.lit("P"))
    inc.delete_insert(made.warehouse, "orders_kept", pending, "o_orderkey")
    kept = made.warehouse.manifest("orders_kept")
    old = [s for s in kept.segments if "=1995" in s]
    made.warehouse.publish(kept, made.warehouse.read("orders_kept").limit(0), replaced=old)
    made.refresh_if_stale("status_totals", start + dt.timedelta(hours=6))
    return made.read("status_totals")


@query("replace_contents", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def replace_all(spark, sf_dir):
    made = project(spark, sf_dir)
    customer = made.source("raw", "customer").select("c_custkey", "c_name", "c_mktsegment")
    made.warehouse.create("managed", customer, properties={"description": "kept"})
    replace_contents(made.warehouse, "managed", customer.where(F.col("c_mktsegment") == "BUILDING"))
    return made.warehouse.read("managed")


@query(
    "model_join",
    """
    SELECT c_mktsegment, o_orderpriority, COUNT(*) AS orders, MAX(o_totalprice) AS top_price
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus <> 'P' GROUP BY 1, 2
    """,
)
def model_join(spark, sf_dir):
    made = project(spark, sf_dir)

    @made.model(materialized="table")
    def settled_orders(ctx):
        return ctx.source("raw", "orders").where(F.col("o_orderstatus") != "P")

    @made.model(materialized="ephemeral")
    def segment_orders(ctx):
        joined = ctx.ref("settled_orders").join(
            ctx.source("raw", "customer"), F.col("o_custkey") == F.col("c_custkey")
        )
        return joined.groupBy("c_mktsegment", "o_orderpriority").agg(
            F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("top_price")
        )

    made.run("settled_orders")
    return made.read("segment_orders")


@query(
    "ephemeral_chain",
    """
    SELECT o_custkey, COUNT(*) AS large_open FROM orders
    WHERE o_orderstatus = 'O' AND o_totalprice > 100000 GROUP BY 1
    """,
)
def ephemeral_chain(spark, sf_dir):
    made = project(spark, sf_dir)

    @made.model(materialized="ephemeral")
    def open_orders(ctx):
        return ctx.source("raw", "orders").where(F.col("o_orderstatus") == "O")

    @made.model(materialized="ephemeral")
    def large_open(ctx):
        return ctx.ref("open_orders").where(F.col("o_totalprice") > 100000)

    @made.model(materialized="table")
    def large_open_per_customer(ctx):
        return ctx.ref("large_open").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("large_open"))

    made.run("large_open_per_customer")
    return made.read("large_open_per_customer")


@query(
    "ephemeral_diamond",
    """
    WITH a AS (SELECT o_custkey, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2)
    SELECT 'open' AS kind, o_custkey, n FROM a WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'final' AS kind, o_custkey, n FROM a WHERE o_orderstatus = 'F'
    """,
)
def ephemeral_diamond(spark, sf_dir):
    made = project(spark, sf_dir)

    @made.model(materialized="ephemeral")
    def per_status(ctx):
        return ctx.source("raw", "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))

    def branch(kind, status):
        @made.model(materialized="ephemeral", name=f"{kind}_orders")
        def body(ctx):
            mine = ctx.ref("per_status").where(F.col("o_orderstatus") == status)
            return mine.select(F.lit(kind).alias("kind"), "o_custkey", "n")

    branch("open", "O")
    branch("final", "F")

    @made.model(materialized="ephemeral")
    def both(ctx):
        return ctx.ref("open_orders").unionAll(ctx.ref("final_orders"))

    return made.read("both")


@query(
    "var_filter",
    "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1999-03-01' AND o_totalprice > 50000",
)
def var_filter(spark, sf_dir):
    made = project(spark, sf_dir, start_date="1999-03-01", threshold=50000.0)

    @made.model(materialized="ephemeral")
    def recent(ctx):
        return ctx.sql(
            "SELECT o_orderkey, o_orderdate, o_totalprice FROM {orders}"
            " WHERE o_orderdate >= CAST(:start_date AS TIMESTAMP_NTZ)",
            orders=ctx.source("raw", "orders"),
        ).where(F.col("o_totalprice") > ctx.var("threshold"))

    return made.read("recent")


@macro
def in_thousands(amount):
    return F.floor(amount / 1000)


@macro
def label(name, amount):
    return F.concat(F.upper(name), F.lit(":"), in_thousands(amount).cast("string"))


@query(
    "macro_projection",
    """
    SELECT c_custkey, upper(c_name) || ':' || CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR) AS label
    FROM customer
    """,
)
def macro_projection(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", label("c_name", "c_acctbal").alias("label"))


@query("sql_job", "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def sql_job(spark, sf_dir):
    return run_sql(
        spark,
        "SELECT o_orderpriority, COUNT(*) AS n FROM {orders} WHERE o_orderstatus = :status GROUP BY o_orderpriority",
        args={"status": "F"},
        orders=table(spark, sf_dir, "orders"),
    )


@query(
    "sql_script",
    """
    SELECT o_orderstatus, COUNT(*) AS n FROM orders
    WHERE o_totalprice > (SELECT MAX(o_totalprice) / 2 FROM orders) GROUP BY 1
    """,
)
def sql_script(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("script_orders")
    return run_script(
        spark,
        [
            "DECLARE half DOUBLE",
            "SET half = (SELECT MAX(o_totalprice) / 2 FROM script_orders)",
            "SELECT o_orderstatus, COUNT(*) AS n FROM script_orders WHERE o_totalprice > half GROUP BY o_orderstatus",
        ],
    )
