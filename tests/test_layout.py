import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import incremental as inc
from tablecraft.operators.layout import (
    Layout, LayoutError, PartitionRule, collate, condition, date_partition, expire_partitions, expire_table, literal,
    range_partition, scan, time_partition,
)
from tests.conftest import as_rows


def hours(spark, n=100):
    return spark.sql(
        f"SELECT id, timestamp_ntz'2023-12-30' + make_dt_interval(0, CAST(id AS INT) * 7) AS ts FROM range({n})"
    )


FILTERS = [
    [("ts", ">=", dt.datetime(2024, 1, 3, 5))],
    [("ts", "<", dt.datetime(2024, 1, 3))],
    [("ts", "<=", dt.datetime(2024, 1, 3))],
    [("ts", ">", dt.datetime(2024, 1, 3)), ("ts", "<", dt.datetime(2024, 1, 9, 7))],
    [("ts", "==", dt.datetime(2023, 12, 30, 7))],
    [("ts", "in", [dt.datetime(2023, 12, 30), dt.datetime(2024, 1, 8, 20)])],
    [("ts", "between", (dt.datetime(2023, 12, 31), dt.datetime(2024, 1, 1)))],
    [("ts", "!=", dt.datetime(2023, 12, 30))],
    [("ts", "is_null", None)],
    [("ts", "not_null", None)],
    [("id", "<", 10)],
]


@pytest.mark.parametrize("granularity", ["HOUR", "DAY", "MONTH", "YEAR"])
def test_pruned_scans_lose_nothing(spark, warehouse, granularity):
    df = hours(spark, 60).unionByName(spark.sql("SELECT -1L AS id, CAST(NULL AS TIMESTAMP_NTZ) AS ts"))
    warehouse.create("t", df, Layout(rules=(time_partition("ts", granularity),)))
    for where in FILTERS:
        plain = warehouse.read("t")
        for name, op, value in where:
            plain = plain.where(condition(name, op, value, plain.schema[name].dataType))
        assert as_rows(scan(warehouse, "t", where), "id") == as_rows(plain, "id"), where


def test_range_partition_and_overflow(spark, warehouse):
    df = spark.range(-10, 60).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id"))
    warehouse.create("t", df, Layout(rules=(range_partition("id", 0, 40, 10),)))
    assert len(warehouse.manifest("t").segments) == 5
    for op, value in [("==", 15), ("==", 45), ("==", -3), ("<", 20), ("<=", -5), (">", 35), (">=", 39), ("in", [1, 50]),
                      ("between", (5, 12)), ("is_null", None), ("!=", 3)]:
        wanted = as_rows(df.where(condition("id", op, value)))
        assert as_rows(scan(warehouse, "t", [("id", op, value)])) == wanted, (op, value)


def test_scan_reads_only_matching_directories(spark, warehouse):
    warehouse.create("t", hours(spark), Layout(rules=(time_partition("ts", "DAY"),)))
    one_day = scan(warehouse, "t", [("ts", ">=", dt.datetime(2024, 1, 5)), ("ts", "<", dt.datetime(2024, 1, 6))])
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_p_ts" in plan
    assert "GreaterThanOrEqual(ts" in plan
    assert {f.rsplit("/", 2)[1] for f in one_day.inputFiles()} <= {"_p_ts=2024-01-05", "_p_ts=2024-01-06"}


def test_direct_date_column(spark, warehouse):
    df = hours(spark).select("id", F.to_date("ts").alias("d"))
    warehouse.create("t", df, Layout(rules=(date_partition("d"),)))
    assert warehouse.read("t").schema["d"].dataType.typeName() == "date"
    picked = scan(warehouse, "t", [("d", "==", dt.date(2024, 1, 1))])
    assert as_rows(picked) == as_rows(df.where("d = DATE'2024-01-01'"))
    assert len(picked.inputFiles()) == 1


def test_load_time_partition(spark, warehouse):
    layout = Layout.of(partition_by={})
    warehouse.create("t", spark.range(2), layout, run_ts=dt.datetime(2024, 5, 6, 7))
    assert warehouse.read("t").columns == ["id", "run_ts"]
    assert warehouse.manifest("t").segments[0].endswith("_p_run_ts=2024-05-06")


def test_a_scan_without_partition_filter_is_refused(spark, warehouse):
    warehouse.create("t", hours(spark), Layout(rules=(time_partition("ts"),), require_filter=True))
    with pytest.raises(LayoutError, match="requires a filter"):
        scan(warehouse, "t", [("id", "==", 1)])
    with pytest.raises(LayoutError, match="requires a partition filter"):
        warehouse.read("t")
    for op, value in (("not_null", None), ("!=", dt.datetime(2024, 1, 1))):  # neither leaves a directory out
        with pytest.raises(LayoutError, match="requires a filter"):
            scan(warehouse, "t", [("TS", op, value)])
    assert scan(warehouse, "t", [("TS", ">=", dt.datetime(1970, 1, 1))]).count() == 100
    assert scan(warehouse, "t", [("TS", "in", [dt.datetime(1970, 1, 1), None])]).count() == 0


def test_an_empty_string_is_no_null_in_a_partition_column(spark, warehouse):
    rows = [(1, ""), (2, "x"), (3, None), (4, "v"), (5, "a/b=c")]
    warehouse.create("t", spark.createDataFrame(rows, "k int, p string"), Layout(rules=(date_partition("p"),)))
    assert sorted((r["k"], r["p"]) for r in warehouse.read("t").collect()) == rows
    assert [r["k"] for r in scan(warehouse, "t", [("p", "==", "")]).collect()] == [1]
    assert sorted(r["k"] for r in scan(warehouse, "t", [("p", "in", ["", "x", None])]).collect()) == [1, 2]
    assert [r["k"] for r in scan(warehouse, "t", [("p", "is_null", None)]).collect()] == [3]
    assert sorted(r["k"] for r in scan(warehouse, "t", [("p", ">", "a/b")]).collect()) == [2, 4, 5]
    inc.merge(warehouse, "t", spark.createDataFrame([(9, ""), (10, "new")], "k int, p string"), "p")
    assert sorted((r["k"], r["p"]) for r in warehouse.read("t").where("p in ('', 'new')").collect()) == [(9, ""), (10, "new")]
    assert warehouse.read("t").count() == 6


def test_layout_rules():
    with pytest.raises(LayoutError, match="at most 4"):
        Layout(cluster_by=tuple("abcde"))
    with pytest.raises(LayoutError, match="needs partition_by"):
        Layout.of(require_partition_filter=True)
    with pytest.raises(LayoutError, match="needs partition_by"):
        Layout.of(partition_expiration_days=3)
    with pytest.raises(LayoutError, match="must name a field"):
        Layout.of({"field": ""})
    with pytest.raises(LayoutError, match="granularity"):
        Layout.of({"field": "x", "data_type": "timestamp", "granularity": "week"})
    assert Layout.of({"field": "x", "data_type": "TIMESTAMP"}).rules[0].granularity == "DAY"
    assert Layout.of({"field": "x", "data_type": "int64", "range": {"start": 0, "end": 9, "interval": 3}}).rules[0].kind == "range"
    made = Layout.of({"field": "x", "data_type": "datetime"}, ["a"])
    assert Layout.from_json(made.to_json()) == made


def test_clustered_files_are_sorted_and_spread(spark, warehouse):
    # One value holds a third of the rows and must not land in one file.
    df = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("c"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        warehouse.create("t", df, Layout(cluster_by=("c",)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = warehouse.read("t").withColumn("f", F.input_file_name())
    assert files.where("c = 7").select("f").distinct().count() >= 2
    spans = files.groupBy("f").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).orderBy("lo", "hi").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(spans, spans[1:], strict=False))


def test_expiry(spark, warehouse):
    warehouse.create("t", hours(spark), Layout(rules=(time_partition("ts", "DAY"),)))
    now = dt.datetime(2024, 1, 20)
    assert expire_partitions(warehouse, "t", now, days=15) == 6
    assert warehouse.read("t").agg(F.min("ts")).first()[0] >= dt.datetime(2024, 1, 5)
    assert expire_partitions(warehouse, "t", now, ms=15 * 86_400_000) == 0
    with pytest.raises(LayoutError, match="give days or ms"):
        expire_partitions(warehouse, "t", now)
    warehouse.create("plain", spark.range(1), properties={"expires_at": "2024-01-01T00:00:00"})
    with pytest.raises(LayoutError, match="no time partitioning"):
        expire_partitions(warehouse, "plain", now, days=1)
    assert not expire_table(warehouse, "plain", dt.datetime(2023, 1, 1))
    assert expire_table(warehouse, "plain", now)
    assert not warehouse.exists("plain")


def test_default_expirations(spark, warehouse):
    from tablecraft.sources.warehouse import Warehouse

    strict = Warehouse(spark, warehouse.root, dt.timedelta(days=2), default_partition_expiration_days=15)
    now = dt.datetime(2024, 1, 20)
    strict.create("t", hours(spark), Layout(rules=(time_partition("ts", "DAY"),)), run_ts=now)
    assert expire_partitions(strict, "t", now) == 6
    assert not expire_table(strict, "t", now + dt.timedelta(days=1))
    assert expire_table(strict, "t", now + dt.timedelta(days=2))


def test_collation(spark, warehouse):
    df = spark.sql("SELECT * FROM VALUES ('a', 1), ('A', 2), ('b', 3) t(k, n)")
    assert as_rows(collate(df, "und:ci", ["k"]).groupBy("k").sum("n"), "sum(n)") == [(3,), (3,)]
    warehouse.create("t", df, properties={"default_collation": "und:ci"})
    assert warehouse.read("t").where("k = 'A'").count() == 2
    joined = warehouse.read("t").alias("x").join(warehouse.read("t").alias("y"), F.expr("x.k = y.k"))
    assert joined.count() == 5


def test_literals_take_the_column_type(spark):
    from pyspark.sql import types as T

    row = spark.range(1).select(literal(dt.datetime(2024, 1, 1, 2), T.TimestampNTZType()).alias("x"))
    assert row.schema["x"].dataType == T.TimestampNTZType()
    assert row.first()["x"] == dt.datetime(2024, 1, 1, 2)
    assert PartitionRule("range", "x", "_p_x", start=0, end=10, interval=5).may_hold("0", "==", 7) is False


def test_zoned_timestamps(spark, warehouse):
    """Directory names follow the writer's zone; another zone reads all, but right."""
    df = spark.sql("SELECT id, TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS ts FROM range(72)")
    warehouse.create("t", df, Layout(rules=(time_partition("ts", "DAY"),)))
    where = [("ts", ">=", dt.datetime(2024, 1, 2, 20, tzinfo=dt.UTC))]
    assert scan(warehouse, "t", [("ts", ">=", dt.datetime(2024, 1, 2, 20))]).count() == 28
    assert scan(warehouse, "t", where).count() == 28
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert scan(warehouse, "t", where).count() == 28
        assert scan(warehouse, "t", [("ts", "<", dt.datetime(2024, 1, 1, 10))]).count() == 1
        with pytest.raises(LayoutError, match="time zone UTC"):
            warehouse.append("t", df)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_high_water_mark_of_a_zoned_timestamp(spark, warehouse):
    from tablecraft.operators.incremental import high_water_mark, newer_than

    df = spark.sql("SELECT id, TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS ts FROM range(72)")
    warehouse.create("t", df.where("id < 50"))
    mark = high_water_mark(warehouse, "t", "ts")
    assert mark == dt.datetime(2024, 1, 3, 1, tzinfo=dt.UTC)
    assert newer_than(df, "ts", mark).count() == 22
