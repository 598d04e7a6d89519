"""Column evolution, declared schemas, drift and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.operators.evolve import evolve
from tablecraft.plans.contract import contract_report, drift
from tablecraft.plans.schema import Field, conform, required_violations, round_numeric
from tablecraft.sources.warehouse import Warehouse
from tablecraft.suite.registry import query, table


def evolved(spark, sf_dir, fields):
    warehouse = Warehouse(spark)
    warehouse.create("part", table(spark, sf_dir, "part"))
    evolve(warehouse, "part", fields)
    return warehouse.read("part")


KEPT = {
    "p_partkey": "INT64", "p_name": "STRING", "p_brand": "STRING", "p_type": "STRING", "p_size": "INT64",
    "p_retailprice": "FLOAT64",
}


def kept(*names):
    return [Field(n, KEPT[n]) for n in names]


@query("evo_add", "SELECT *, 'EUR' AS currency, CAST(7 AS BIGINT) AS grade FROM part")
def evo_add(spark, sf_dir):
    return evolved(
        spark, sf_dir,
        [*kept(*KEPT), Field("currency", "STRING", alter="insert", default="'EUR'"),
         Field("grade", "INT64", alter="insert", default="3 + 4")],
    )


@query("evo_drop", "SELECT p_partkey, p_name, p_type, p_retailprice FROM part")
def evo_drop(spark, sf_dir):
    gone = [Field("p_brand", "STRING", alter="delete"), Field("P_SIZE", "INT64", alter="delete")]
    return evolved(spark, sf_dir, [*kept("p_partkey", "p_name", "p_type", "p_retailprice"), *gone])


@query(
    "evo_rename",
    "SELECT p_partkey AS part_id, p_name, p_brand, p_type, p_size, p_retailprice AS list_price FROM part",
)
def evo_rename(spark, sf_dir):
    renamed = [
        Field("part_id", "INT64", alter="rename", alter_from="p_partkey"),
        Field("list_price", "FLOAT64", alter="rename", alter_from="p_retailprice"),
    ]
    return evolved(spark, sf_dir, [*kept("p_name", "p_brand", "p_type", "p_size"), *renamed])


@query(
    "evo_rename_swap",
    "SELECT p_partkey, p_brand AS p_name, p_type AS p_brand, p_name AS p_type, p_size, p_retailprice FROM part",
)
def evo_rename_swap(spark, sf_dir):
    """A cycle of three renames in one step."""
    cycle = [
        Field("p_brand", "STRING", alter="rename", alter_from="p_type"),
        Field("p_name", "STRING", alter="rename", alter_from="p_brand"),
        Field("p_type", "STRING", alter="rename", alter_from="p_name"),
    ]
    return evolved(spark, sf_dir, [*kept("p_partkey", "p_size", "p_retailprice"), *cycle])


@query(
    "evo_combined",
    "SELECT p_partkey, p_name AS title, p_type, p_size, p_retailprice, 'new' AS p_brand, 'none' AS note FROM part",
)
def evo_combined(spark, sf_dir):
    """Drop, rename, add and describe; the dropped name comes back as a new column."""
    warehouse = Warehouse(spark)
    warehouse.create("part", table(spark, sf_dir, "part"))
    evolve(
        warehouse, "part",
        [
            *kept("p_partkey", "p_type", "p_size"),
            Field("p_retailprice", "FLOAT64", description="list price"),
            Field("p_brand", "STRING", alter="delete"),
            Field("title", "STRING", alter="rename", alter_from="p_name"),
            Field("note", "STRING", alter="insert", default="'none'"),
        ],
    )
    evolve(
        warehouse, "part",
        [
            *kept("p_partkey", "p_type", "p_size"),
            Field("p_retailprice", "FLOAT64", description="list price"),
            Field("title", "STRING"),
            Field("note", "STRING"),
            Field("p_brand", "STRING", alter="insert", default="'new'"),
        ],
    )
    return warehouse.read("part")


@query(
    "evo_rounding",
    """
    WITH p AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part)
    SELECT p_partkey,
           CAST((cents + 100) // 200 AS BIGINT) AS away,
           CAST(CASE WHEN cents % 200 > 100 OR (cents % 200 = 100 AND (cents // 200) % 2 = 1)
                THEN cents // 200 + 1 ELSE cents // 200 END AS BIGINT) AS even
    FROM p
    """,
)
def evo_rounding(spark, sf_dir):
    """A price times 5e-10 has a tie at the ninth place when it is a whole odd amount."""
    tiny = F.col("p_retailprice").cast("decimal(12,2)") * F.lit("0.0000000005").cast("decimal(12,10)")
    units = F.lit(1_000_000_000).cast("decimal(10,0)")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        (round_numeric(tiny, "ROUND_HALF_AWAY_FROM_ZERO") * units).cast("bigint").alias("away"),
        (round_numeric(tiny, "ROUND_HALF_EVEN") * units).cast("bigint").alias("even"),
    )


NESTED = [
    Field("o_orderkey", "INT64", mode="REQUIRED"),
    Field("state", "STRUCT", fields=(Field("status", "STRING"), Field("priority", "STRING"), Field("reason", "STRING"))),
    Field("tags", "STRING", mode="REPEATED"),
    Field("parts", "RECORD", mode="REPEATED", fields=(Field("code", "STRING"), Field("size", "INT64"))),
]


@query(
    "evo_nested",
    """
    SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, coalesce(NULL, 'none') AS reason,
           o_orderstatus || ',' || o_orderpriority AS tags, o_orderpriority AS code, length(o_orderpriority) AS size
    FROM orders
    """,
)
def evo_nested(spark, sf_dir):
    """Nested data takes its declared shape; the missing nested field is NULL."""
    raw = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).alias("state"),
        F.array("o_orderstatus", "o_orderpriority").alias("tags"),
        F.array(F.struct(F.length("o_orderpriority").alias("size"), F.col("o_orderpriority").alias("code"))).alias("parts"),
    )
    shaped = conform(raw, NESTED)
    return shaped.select(
        "o_orderkey", "state.status", "state.priority", F.coalesce("state.reason", F.lit("none")).alias("reason"),
        F.array_join("tags", ",").alias("tags"), F.col("parts")[0]["code"].alias("code"),
        F.col("parts")[0]["size"].alias("size"),
    )


@query(
    "required_violations",
    """
    SELECT 'user_id' AS column_name, CAST(0 AS BIGINT) AS violations
    UNION ALL SELECT 'value', COUNT(*) FROM events WHERE event_type = 'error'
    """,
)
def required(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    holes = events.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    fields = [Field("user_id", "INT64", mode="REQUIRED"), Field("value", "FLOAT64", mode="REQUIRED"), Field("ts", "DATETIME")]
    return required_violations(holes, fields)


DECLARED = [
    Field("p_partkey", "INT64"), Field("P_NAME", "STRING"), Field("p_brand", "INTEGER"), Field("p_size", "INT64"),
    Field("p_retailprice", "NUMERIC"), Field("p_weight", "FLOAT64"), Field("p_tags", "STRING", mode="REPEATED"),
]


@query(
    "schema_drift",
    """
    SELECT v.*, n AS affected_rows FROM (VALUES
      ('p_brand', 'type_mismatch', 'INT64', 'STRING'), ('p_retailprice', 'type_mismatch', 'NUMERIC', 'FLOAT64'),
      ('p_weight', 'missing', 'FLOAT64', '-'), ('p_tags', 'missing', 'STRING', '-'), ('p_type', 'extra', '-', 'STRING')
    ) v(column_name, kind, declared, actual), (SELECT COUNT(*) AS n FROM part)
    """,
)
def schema_drift(spark, sf_dir):
    return drift(DECLARED, table(spark, sf_dir, "part")).fillna("-", ["declared", "actual"])


@query(
    "contract_report",
    """
    SELECT v.*, n AS affected_rows FROM (VALUES
      ('part_id', 'unique_key_not_found', '-', '-'), ('p_region', 'cluster_by_not_found', '-', '-'),
      ('p_brand', 'type_mismatch', 'INT64', 'STRING'), ('p_retailprice', 'type_mismatch', 'NUMERIC', 'FLOAT64'),
      ('p_weight', 'missing', 'FLOAT64', '-'), ('p_type', 'undeclared', '-', 'STRING')
    ) v(column_name, kind, declared, actual), (SELECT COUNT(*) AS n FROM part)
    """,
)
def contract(spark, sf_dir):
    report = contract_report(
        table(spark, sf_dir, "part"), declared=DECLARED, unique_key=["part_id"], cluster_by=["p_brand", "p_region"]
    )
    return report.fillna("-", ["declared", "actual"])
