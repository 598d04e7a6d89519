import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablecraft.operators.layout import LayoutError
from tablecraft.plans.contract import ContractError
from tablecraft.plans.project import Project, ProjectError, create_sql_view, replace_contents
from tablecraft.plans.schema import Field, SchemaError
from tests.conftest import as_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def project(spark, warehouse):
    return Project(spark, warehouse, sources={"raw": {"orders": f"{SF}/orders.parquet"}}, vars={"floor": 10})


def test_unknown_names_list_what_exists(project):
    with pytest.raises(ProjectError, match="unknown source 'row'; declared: raw"):
        project.source("row", "orders")
    with pytest.raises(ProjectError, match="has no table 'order'; it has: orders"):
        project.source("raw", "order")

    @project.model(materialized="ephemeral")
    def bad_var(ctx):
        return ctx.source("raw", "orders").where(F.col("o_orderkey") > ctx.var("ceiling"))

    @project.model(materialized="ephemeral")
    def bad_ref(ctx):
        return ctx.ref("nothing")

    with pytest.raises(ProjectError, match="unknown variable 'ceiling'; available: floor"):
        project.read("bad_var")
    with pytest.raises(ProjectError, match="unknown model 'nothing'"):
        project.read("bad_ref")


def test_ephemeral_bodies_run_once_per_run(project):
    calls = []

    @project.model(materialized="ephemeral")
    def a(ctx):
        calls.append("a")
        return ctx.spark.range(3)

    @project.model(materialized="ephemeral")
    def b(ctx):
        return ctx.ref("a").unionAll(ctx.ref("a"))

    @project.model(materialized="ephemeral")
    def c(ctx):
        return ctx.ref("a").unionAll(ctx.ref("b"))

    assert project.read("c").count() == 9
    assert calls == ["a"]
    assert not project.warehouse.exists("a")


def test_circles_are_refused(project):
    @project.model(materialized="ephemeral")
    def a(ctx):
        return ctx.ref("b")

    @project.model(materialized="ephemeral")
    def b(ctx):
        return ctx.ref("a")

    with pytest.raises(ProjectError, match="a -> b -> a"):
        project.read("a")


def test_stored_models_must_have_run(project):
    @project.model()
    def stored(ctx):
        return ctx.spark.range(1)

    @project.model()
    def reader(ctx):
        return ctx.ref("stored")

    with pytest.raises(ProjectError, match="'stored' has not been run yet"):
        project.run("reader")
    project.run("stored")
    project.run("reader")
    assert project.read("reader").count() == 1


@pytest.mark.parametrize(
    ("options", "message"),
    [
        ({"materialized": "cube"}, "invalid materialization"),
        ({"materialized": "incremental"}, "needs a unique_key"),
        ({"materialized": "incremental", "unique_key": "id", "incremental_strategy": "upsert"}, "invalid incremental_strategy"),
        ({"enable_refresh": True}, "only with a materialized_view"),
        ({"materialized": "materialized_view", "refresh_interval_minutes": 5}, "needs enable_refresh"),
    ],
)
def test_configuration_rules(project, options, message):
    with pytest.raises(ProjectError, match=message):
        project.model(name="m", **options)(lambda ctx: ctx.spark.range(1))


def test_layout_rules_reach_the_model(project):
    with pytest.raises(LayoutError, match="at most 4"):
        project.model(cluster_by=list("abcde"))(lambda ctx: ctx.spark.range(1))


@pytest.mark.parametrize(("strategy", "wanted"), [("merge", [0, 1, 2, 30, 40]), ("delete+insert", [0, 1, 2, 30, 40]), ("append", [0, 1, 2, 3, 30, 40])])
def test_first_run_is_full_and_later_runs_are_incremental(project, strategy, wanted):
    seen = []

    @project.model(materialized="incremental", unique_key="id", incremental_strategy=strategy)
    def numbers(ctx):
        seen.append(ctx.is_incremental)
        if ctx.is_incremental:
            return ctx.spark.range(3, 5).withColumn("x", F.col("id") * 10)
        return ctx.spark.range(4).withColumn("x", F.col("id"))

    project.run("numbers")
    project.run("numbers")
    assert seen == [False, True]
    assert sorted(r["x"] for r in project.read("numbers").collect()) == wanted
    project.run("numbers", full_refresh=True)
    assert project.read("numbers").count() == 4


def test_an_edited_model_is_rebuilt(project):
    def declare(factor):
        if factor == 1:
            @project.model(materialized="incremental", unique_key="id")
            def m(ctx):
                return ctx.spark.range(2).withColumn("x", F.lit(1))
        else:
            @project.model(materialized="incremental", unique_key="id")
            def m(ctx):
                return ctx.spark.range(1).withColumn("x", F.lit(2))

    declare(1)
    project.run("m")
    declare(2)
    project.run("m")
    assert as_rows(project.read("m")) == [(0, 2)]


def test_this_and_newer(project):
    @project.model(materialized="incremental", unique_key="id", incremental_strategy="append")
    def m(ctx):
        rows = ctx.spark.range(ctx.var_value("floor"))
        if ctx.is_incremental:
            assert ctx.this().count() == 10
            rows = ctx.newer(rows, "id")
        return rows

    project.run("m")
    project.vars["floor"] = 15
    project.run("m")
    assert sorted(r[0] for r in project.read("m").collect()) == list(range(15))


def test_this_needs_a_table(project):
    @project.model(materialized="incremental", unique_key="id")
    def m(ctx):
        return ctx.this()

    with pytest.raises(ProjectError, match="has no table yet"):
        project.run("m")


def test_a_table_managed_elsewhere(project):
    @project.model(owns_table=False)
    def managed(ctx):
        return ctx.spark.range(5, 8)

    with pytest.raises(ProjectError, match="does not exist"):
        project.run("managed")
    project.warehouse.create("managed", project.spark.range(2), properties={"description": "theirs"})
    project.run("managed")
    assert sorted(r[0] for r in project.read("managed").collect()) == [5, 6, 7]
    assert project.warehouse.manifest("managed").properties["description"] == "theirs"
    project.drop("managed")
    assert project.warehouse.exists("managed")


def test_replace_contents_checks_columns(project):
    project.warehouse.create("t", project.spark.range(2))
    with pytest.raises(ValueError, match="unknown columns: x"):
        replace_contents(project.warehouse, "t", project.spark.range(1).withColumn("x", F.lit(1)))


def test_views_are_always_current(project):
    project.warehouse.create("base", project.spark.range(2))
    project.model(name="base", owns_table=False)(lambda ctx: ctx.spark.range(2))

    @project.model(materialized="view")
    def doubled(ctx):
        return ctx.ref("base").withColumn("id", F.col("id") * 2)

    project.run("doubled")
    assert project.spark.table("doubled").count() == 2
    project.warehouse.append("base", project.spark.range(1))
    assert project.read("doubled").count() == 3


def test_sql_view(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS view_base USING parquet AS SELECT 1 AS id")
    try:
        create_sql_view(spark, "view_over", "SELECT id + 1 AS id FROM view_base")
        assert spark.table("view_over").first()[0] == 2
    finally:
        spark.sql("DROP VIEW IF EXISTS view_over")
        spark.sql("DROP TABLE IF EXISTS view_base")


def test_materialized_view_refresh(project):
    project.warehouse.create("base", project.spark.range(2))
    project.model(name="base", owns_table=False)(lambda ctx: ctx.spark.range(2))

    @project.model(materialized="materialized_view", max_staleness=dt.timedelta(hours=4))
    def total(ctx):
        return ctx.ref("base").agg(F.count(F.lit(1)).alias("n"))

    t0 = dt.datetime(2024, 1, 1)
    assert project.refresh_if_stale("total", t0)
    project.warehouse.append("base", project.spark.range(5))
    assert not project.refresh_if_stale("total", t0 + dt.timedelta(hours=3))
    assert project.read("total").first()["n"] == 2
    assert project.refresh_if_stale("total", t0 + dt.timedelta(hours=5))
    assert project.read("total").first()["n"] == 7


def test_contract_is_checked_before_the_write(project):
    @project.model(schema=[Field("id", "INT64"), Field("name", "STRING")])
    def m(ctx):
        return ctx.spark.range(1)

    with pytest.raises(ContractError, match="name: missing"):
        project.run("m")
    assert not project.warehouse.exists("m")

    @project.model(cluster_by="nope")
    def n(ctx):
        return ctx.spark.range(1)

    with pytest.raises(ContractError, match="cluster_by_not_found"):
        project.run("n")


def test_options_are_stored(project):
    @project.model(description="d", friendly_name="f", labels={"a": "b"}, partition_by={"data_type": "timestamp"})
    def m(ctx):
        return ctx.spark.range(1).withColumn("at", ctx.now())

    project.run("m", run_ts=dt.datetime(2024, 2, 3))
    found = project.warehouse.manifest("m")
    assert (found.properties["description"], found.properties["friendly_name"], found.properties["labels"]) == ("d", "f", {"a": "b"})
    assert project.read("m").first()["run_ts"] == dt.datetime(2024, 2, 3)


def test_references_carry_filters(project):
    @project.model(partition_by={"field": "at", "data_type": "datetime"}, require_partition_filter=True)
    def days(ctx):
        return ctx.spark.sql("SELECT id, timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id AS INT)) AS at FROM range(10)")

    @project.model(materialized="ephemeral")
    def late(ctx):
        return ctx.ref("days", where=[("at", ">=", dt.datetime(2024, 1, 8))])

    project.run("days")
    assert len(project.read("late").inputFiles()) == 3
    assert project.read("late", where=[("id", "<", 9)]).count() == 2
    with pytest.raises(LayoutError, match="requires a filter"):
        project.read("days")


def test_columns_that_other_models_rely_on_are_not_dropped(project):
    @project.model()
    def base(ctx):
        return ctx.spark.sql("SELECT id, id % 3 AS part, 'x' AS note FROM range(9)")

    @project.model(materialized="view")
    def between(ctx):
        return ctx.ref("base").where("id > 1")

    @project.model(materialized="incremental", unique_key="part")
    def reader(ctx):
        return ctx.ref("between").groupBy("part").count()

    @project.model(cluster_by=["gone"])
    def broken(ctx):
        return ctx.ref("nothing_yet")

    project.run("base")
    assert list(project.consumers("base").unique_keys) == ["part"] and not project.consumers("reader").unique_keys
    columns = [Field("id", "INT64"), Field("part", "INT64"), Field("note", "STRING", alter="delete")]
    project.evolve("base", columns)
    assert project.warehouse.read("base").columns == ["id", "part"]
    with pytest.raises(SchemaError, match="column 'part' has to stay"):
        project.evolve("base", [Field("id", "INT64"), Field("part", "INT64", alter="delete")])
