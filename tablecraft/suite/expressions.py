"""Column functions and user-defined functions."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tablecraft.functions import builtins as fn
from tablecraft.functions.routines import (
    Argument, create_function, create_procedure, create_python_function, create_table_function,
)
from tablecraft.suite.registry import query, table


@query(
    "fn_datediff",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           date_sub('day', o_orderdate, l_shipdate + INTERVAL 5 HOUR) AS days,
           date_sub('hour', o_orderdate, l_shipdate + INTERVAL 5 HOUR) AS hours,
           date_sub('minute', l_shipdate + INTERVAL 5 HOUR, o_orderdate) AS minutes_back
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
def fn_datediff(spark, sf_dir):
    """Nested: the end of each difference is itself a moved timestamp."""
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    end = fn.dateadd("hour", 5, "l_shipdate")
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        fn.datediff("o_orderdate", end, "day").alias("days"),
        fn.datediff("o_orderdate", end, "'HOUR'").alias("hours"),
        fn.datediff(end, "o_orderdate", "minute").alias("minutes_back"),
    )


@query(
    "fn_dateadd",
    """
    SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS due, o_orderdate - INTERVAL 90 SECOND AS before,
           o_orderdate + to_hours(o_custkey) AS moved
    FROM orders
    """,
)
def fn_dateadd(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        fn.dateadd("day", 10, "o_orderdate").alias("due"),
        fn.dateadd("second", -90, "o_orderdate").alias("before"),
        fn.dateadd("hour", F.col("o_custkey"), "o_orderdate").alias("moved"),
    )


@query(
    "fn_surrogate_key",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           md5(CAST(l_orderkey AS VARCHAR) || CAST(l_linenumber AS VARCHAR) ||
               coalesce(CASE WHEN l_returnflag <> 'N' THEN CAST(l_shipdate AS VARCHAR) END, '_dbt_utils_surrogate_key_null_')) AS row_key
    FROM lineitem
    """,
)
def fn_surrogate_key(spark, sf_dir):
    shipped = F.when(F.col("l_returnflag") != "N", F.col("l_shipdate"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        fn.surrogate_key("l_orderkey", "l_linenumber", shipped).alias("row_key"),
    )


@query(
    "fn_listagg",
    """
    SELECT o_custkey, string_agg(o_orderstatus || o_orderkey, ' > ' ORDER BY o_orderdate, o_orderkey) AS path
    FROM orders GROUP BY 1
    """,
)
def fn_listagg(spark, sf_dir):
    """A customer may hold a third of all orders: folded month by month."""
    value = F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))
    orders = table(spark, sf_dir, "orders")
    return fn.listagg_by(orders, ["o_custkey"], value, " > ", ["o_orderdate", "o_orderkey"], name="path", chunk=F.year("o_orderdate") * 12 + F.month("o_orderdate"))


@query(
    "fn_listagg_unordered",
    """
    SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS suppliers
    FROM lineitem GROUP BY 1
    """,
)
def fn_listagg_unordered(spark, sf_dir):
    """Suppliers per order in no set order; sorted here to compare."""
    listed = fn.listagg_by(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey", ",", name="suppliers")
    return listed.withColumn("suppliers", F.array_join(F.array_sort(F.split("suppliers", ",")), ","))


@query("fn_now", "SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '2001-09-01') AS age FROM orders")
def fn_now(spark, sf_dir):
    """Ages at the run's clock, which is one literal for all rows."""
    clock = fn.now(dt.datetime(2001, 9, 1, tzinfo=dt.UTC))
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.datediff("o_orderdate", clock, "day").alias("age"))


@query("udf_sql_scalar", "SELECT o_orderkey, round(o_custkey / 100.0, 2) AS dollars FROM orders")
def udf_sql_scalar(spark, sf_dir):
    create_function(spark, "tc_dollars", [Argument("cents", "INT64")], "ROUND(cents / 100.0, 2)", "FLOAT64")
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "tc_dollars(o_custkey) AS dollars")


@query(
    "udf_table",
    "SELECT o_orderpriority AS priority, COUNT(*) AS orders FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 GROUP BY 1",
)
def udf_table(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("tc_orders")
    create_table_function(
        spark, "tc_orders_above", [Argument("wanted", "STRING"), Argument("least", "FLOAT64")],
        "SELECT o_orderkey, o_orderpriority FROM tc_orders WHERE o_orderstatus = wanted AND o_totalprice > least",
        [Argument("id", "INT64"), Argument("priority", "STRING")],
    )
    return spark.sql("SELECT priority, COUNT(*) AS orders FROM tc_orders_above('O', 1000D) GROUP BY priority")


@query(
    "udf_python",
    """
    SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1500 THEN 'mid' ELSE 'high' END AS band
    FROM part
    """,
)
def udf_python(spark, sf_dir):
    def band(price: pd.Series) -> pd.Series:
        cut = pd.cut(price, [-float("inf"), 1000, 1500, float("inf")], right=False, labels=["low", "mid", "high"])
        return cut.astype(str)

    made = create_python_function(spark, "tc_band", band, "STRING", determinism="NOT_DETERMINISTIC")
    return table(spark, sf_dir, "part").select("p_partkey", made("p_retailprice").alias("band"))


@query(
    "udf_procedure",
    """
    SELECT o_orderstatus, COUNT(*) AS n, (SELECT MAX(o_orderdate) FROM orders) AS last_day
    FROM orders WHERE o_totalprice >= 100000 GROUP BY 1
    """,
)
def udf_procedure(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("tc_orders")
    steps = [
        "SET VAR tc_last_day = (SELECT MAX(o_orderdate) FROM tc_orders)",
        "SELECT o_orderstatus, COUNT(*) AS n, tc_last_day AS last_day FROM tc_orders"
        " WHERE o_totalprice >= tc_least GROUP BY o_orderstatus",
    ]
    args = [Argument("tc_least", "FLOAT64"), Argument("tc_last_day", "DATETIME", mode="OUT")]
    return create_procedure("totals", args, steps).call(spark, tc_least=100000.0)
