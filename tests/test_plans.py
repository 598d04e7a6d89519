"""Shapes that plans must and must not have, and skewed inputs."""

import functools
import os
import re
import subprocess
import sys
from dataclasses import dataclass
from enum import Enum

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions import builtins as fn
from tablecraft.functions.builtins import macro
from tablecraft.operators import conversations as conv
from tablecraft.operators import incremental as inc
from tablecraft.operators import snapshot as scd
from tablecraft.plans.definition import DefinitionError, code_text
from tablecraft.plans.project import Project
from tablecraft.suite import QUERIES, history
from tablecraft.suite.models import daily_revenue_frame

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when every side is large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    "name",
    ["fn_datediff", "fn_listagg", "conv_fold", "golden_score", "model_join", "scd_insert", "scd_hard_delete", "redact_text", "ephemeral_diamond"],
)
def test_no_nested_loops(spark, no_broadcast, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BroadcastHashJoin" not in text


def test_merge_shuffles_each_side_once_per_join(spark, no_broadcast):
    orders = table(spark, "orders")
    text = plan(inc.merge_frames(orders, orders.where("o_totalprice > 1000"), "o_orderkey"))
    assert text.count("Exchange hashpartitioning") == 4
    # The insert side asks the target for its key only.
    assert "FileScan parquet [o_orderkey#" in text.replace(",", "]", 1) or "ReadSchema: struct<o_orderkey:bigint>" in text


def test_closed_versions_are_not_shuffled(spark, no_broadcast, warehouse):
    for n in range(2):
        scd.snapshot_run(warehouse, "h", history.active_customers(spark, SF, n), "cust", "updated_at", history.clock(n))
    stored = warehouse.read("h")
    text = plan(scd.snapshot_close(stored, history.active_customers(spark, SF, 2), "cust", "updated_at", history.clock(2)))
    assert text.count("SortMergeJoin") == 1
    assert "IsNotNull(dbt_valid_to)" in text


def test_daily_revenue_prunes_columns(spark):
    frames = [table(spark, t) for t in ("orders", "customer", "nation", "region")]
    text = plan(daily_revenue_frame(*frames))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in text


def test_functions_stay_in_the_jvm(spark):
    for name in ("fn_surrogate_key", "fn_datediff", "macro_projection", "redact_text", "msg_extract", "conv_fold", "golden_score"):
        text = plan(QUERIES[name](spark, SF))
        assert "Python" not in text, name


def test_range_chunks_split_a_hot_key(spark):
    """A key with two thirds of the rows is folded by several tasks, in order."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("o"), F.lit("x").alias("v")
    )
    from tablecraft.operators.ordered import CHUNK, with_chunks

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tagged = with_chunks(rows, ["k"], ["o"])
        sizes = {r["n"] for r in tagged.where("k = -1").groupBy(CHUNK).agg(F.count(F.lit(1)).alias("n")).collect()}
        assert max(sizes) < 30_000
        folded = fn.listagg_by(rows.withColumn("v", F.col("o").cast("string")), ["k"], "v", ",", ["o"])
        hot = folded.where("k = -1").first()[1].split(",")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert hot == [str(i) for i in range(60_000) if i % 3]
    assert folded.count() == 20_001


def test_a_very_long_conversation(spark):
    turns = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("c"), F.col("id").alias("t"),
        F.to_json(F.struct(F.struct(F.array(F.col("id").cast("string")).alias("parts")).alias("text"))).alias("j"),
    )
    typed = conv.parse_messages(turns, "j", ["c", "t"])
    folded = conv.fold_conversations(typed, ["c"], ["t"], chunk=F.floor(F.col("t") / 512))
    long = folded.where("c = 0").first()["answer"].split(" ")
    assert long == [str(i) for i in range(30_000) if i % 3 or i == 0]


def test_a_definition_follows_what_the_body_means():
    def body(limit, factor=2):
        def build(ctx):
            return ctx.source("raw", "t").where(f"v > {limit}").limit(ctx.var("floor")), factor
        return build

    assert code_text(body(1)) == code_text(body(1)) != code_text(body(2))
    assert code_text(body(1)) != code_text(body(1, 3))
    assert code_text(body(1), {"floor": 1}) != code_text(body(1), {"floor": 2})
    assert code_text(body(1), {"other": 1}) == code_text(body(1), {"other": 2})


def test_a_definition_without_source_text_is_the_same_in_every_process():
    source = "def helper(x):\n    return x + {n}\ndef build(ctx):\n    return [helper(v) for v in ctx], {{'a', 'b', 'c'}}, lambda y: y * 2"

    def made(n):
        space = {}
        exec(source.format(n=n), space)
        return space["build"]

    assert code_text(made(1)) == code_text(made(1)) != code_text(made(2))
    program = "import sys; sys.path.insert(0, '.'); from tablecraft.plans.definition import code_text; s = {}; exec(sys.argv[1], s); print(code_text(s['build']))"
    runs = {subprocess.run([sys.executable, "-c", program, source.format(n=1)], capture_output=True, text=True, env={**os.environ, "PYTHONHASHSEED": seed}).stdout for seed in ("1", "2")}
    assert len(runs) == 1 and runs.pop().strip() == code_text(made(1))


def test_a_definition_follows_its_macros():
    space = {"macro": macro, "F": F}
    exec("@macro\ndef doubled(x):\n    return x * 2\ndef build(ctx):\n    return doubled('v')", space)
    before = code_text(space["build"])
    exec("@macro\ndef doubled(x):\n    return x * 3", space)
    assert code_text(space["build"]) != before


def test_a_definition_follows_objects_by_their_fields(spark):
    @dataclass
    class Limits:
        floor: int
        names: tuple = ("a",)

    class Plain:
        def __init__(self, floor):
            self.floor, self.me = floor, self

    class Slotted:
        __slots__ = ("floor",)

        def __init__(self, floor):
            self.floor = floor

    class Kind(Enum):
        ONE = 1
        TWO = 2

    def body(value):
        return lambda ctx: ctx.source("raw", "orders").where(value is not None)

    pairs = [
        (Limits(1), Limits(2)), (Limits(1), Limits(1, ("b",))), (Plain(1), Plain(2)), (Slotted(1), Slotted(2)), (Kind.ONE, Kind.TWO),
        (functools.partial(max, 1), functools.partial(max, 2)), (re.compile("a"), re.compile("a", re.I)), (range(3), range(4)), (Limits, Plain),
        ([Limits(1)], [Limits(2)]), ({"x": Plain(1)}, {"x": Plain(2)}), (F.col("a") > 1, F.col("a") > 2), (T.DecimalType(9, 2), T.DecimalType(9, 3)), (len, max),
    ]
    for one, other in pairs:
        assert code_text(body(one)) != code_text(body(other)), one
    for make in (lambda: Limits(1), lambda: Plain(1), lambda: Slotted(1), lambda: F.col("a") > 1, lambda: functools.partial(max, 1), lambda: spark, lambda: spark.range(3)):
        assert code_text(body(make())) == code_text(body(make()))
    with pytest.raises(DefinitionError, match="generator"):
        code_text(body(x for x in "ab"))


def test_an_edited_dataclass_rebuilds_an_incremental_model(spark, warehouse):
    @dataclass
    class Limits:
        floor: int

    def project(limits):
        made = Project(spark, warehouse)

        @made.model(materialized="incremental", unique_key="id", incremental_strategy="append")
        def kept(ctx):
            return spark.range(10).where(F.col("id") >= limits.floor)

        made.run("kept")
        return made.read("kept").count()

    assert [project(Limits(n)) for n in (4, 4, 7)] == [6, 12, 3]
