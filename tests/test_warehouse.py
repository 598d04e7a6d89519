import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import incremental as inc
from tablecraft.operators.layout import Layout, range_partition, time_partition
from tablecraft.sources.warehouse import ConcurrentWriteError, TableError, Warehouse
from tests.conftest import as_rows


def test_versions_are_kept_until_vacuum(spark, warehouse):
    warehouse.create("t", spark.range(3))
    warehouse.overwrite("t", spark.range(5))
    assert warehouse.read("t").count() == 5
    assert warehouse.read("t", version=1).count() == 3
    assert warehouse.vacuum("t") == 0
    assert warehouse.vacuum("t", dt.timedelta(0)) == 1
    assert warehouse.read("t").count() == 5


def test_reader_of_an_old_version_is_undisturbed(spark, warehouse):
    warehouse.create("t", spark.range(3))
    before = warehouse.read("t")
    warehouse.overwrite("t", before.union(before))
    assert before.count() == 3
    assert warehouse.read("t").count() == 6


def test_second_writer_of_a_version_is_refused(spark, warehouse):
    warehouse.create("t", spark.range(3))
    base = warehouse.manifest("t")
    warehouse.append("t", spark.range(1))
    with pytest.raises(ConcurrentWriteError):
        warehouse.publish(base, spark.range(1), replaced=())
    assert warehouse.read("t").count() == 4


def test_a_table_is_found_again_by_its_root(spark, warehouse):
    warehouse.create("t", spark.range(3), properties={"description": "numbers"})
    again = Warehouse(spark, warehouse.root)
    assert again.tables() == ["t"]
    assert again.manifest("t").properties["description"] == "numbers"


def test_drop_and_create_again(spark, warehouse):
    warehouse.create("t", spark.range(3))
    warehouse.drop("t")
    assert not warehouse.exists("t")
    with pytest.raises(TableError):
        warehouse.read("t")
    warehouse.create("t", spark.range(2))
    assert warehouse.read("t").count() == 2


def test_rows_must_fit(spark, warehouse):
    warehouse.create("t", spark.range(3).withColumn("x", F.lit("a")))
    with pytest.raises(TableError, match="unknown columns: y"):
        warehouse.append("t", spark.range(1).withColumn("y", F.lit(1)).withColumn("x", F.lit("b")))
    with pytest.raises(TableError, match="missing columns: x"):
        warehouse.append("t", spark.range(1))
    # Names ignore case, types are cast.
    warehouse.append("t", spark.sql("SELECT 'z' AS X, CAST(9 AS INT) AS ID"))
    assert as_rows(warehouse.read("t").where("id = 9")) == [(9, "z")]


def test_empty_table(spark, warehouse):
    warehouse.create("t", spark.range(3).where("id > 5"), Layout(rules=(range_partition("id", 0, 10, 5),)))
    assert warehouse.read("t").count() == 0
    assert warehouse.read("t", located=True).count() == 0
    warehouse.append("t", spark.range(2))
    assert warehouse.read("t").count() == 2


def test_hidden_levels_do_not_show(spark, warehouse):
    df = spark.sql("SELECT 1 AS id, timestamp_ntz'2024-05-06 07:08:09' AS ts")
    for granularity in ("HOUR", "DAY", "MONTH", "YEAR"):
        warehouse.create(granularity, df, Layout(rules=(time_partition("ts", granularity),)))
        assert warehouse.read(granularity).columns == ["id", "ts"]
    names = {g: warehouse.manifest(g).segments[0].split("=")[-1] for g in ("HOUR", "DAY", "MONTH", "YEAR")}
    assert names == {"HOUR": "2024-05-06-07", "DAY": "2024-05-06", "MONTH": "2024-05-01", "YEAR": "2024-01-01"}


def test_vacuum_leaves_running_writers_and_fresh_readers_alone(spark, warehouse):
    base = warehouse.create("t", spark.range(3))
    added = warehouse.write_segments(base, spark.range(5))
    assert warehouse.vacuum("t", dt.timedelta(0)) == 0
    warehouse.commit(base, segments=[*base.segments, *added], written=warehouse._counted(base, added, base.segments))
    assert warehouse.read("t").count() == 8
    before = warehouse.read("t")
    warehouse.overwrite("t", spark.range(1))
    assert warehouse.vacuum("t") == 0 and before.count() == 8
    assert warehouse.vacuum("t", dt.timedelta(0)) == 2 and warehouse.read("t").count() == 1


def test_one_changed_row_keeps_all_files_but_its_own(spark, warehouse):
    rows = spark.range(0, 10_000, 1, 8).withColumn("v", F.lit("a"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files of a few rows
    warehouse.create("t", rows, Layout(cluster_by=("id",)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = {r[0] for r in warehouse.read("t", located=True).select("__file").distinct().collect()}
    assert len(files) >= 4
    inc.merge(warehouse, "t", spark.sql("SELECT 77L AS id, 'b' AS v UNION ALL SELECT 20000L, 'c'"), "id")
    after = {r[0] for r in warehouse.read("t", located=True).select("__file").distinct().collect()}
    assert len(files - after) == 1
    assert warehouse.read("t").count() == 10_001 and as_rows(warehouse.read("t").where("v <> 'a'")) == [(20000, "c"), (77, "b")]
    inc.delete_insert(warehouse, "t", spark.sql("SELECT 9000L AS id, 'd' AS v"), "id")
    assert len(files - {r[0] for r in warehouse.read("t", located=True).select("__file").distinct().collect()}) == 2
    assert warehouse.read("t").count() == 10_001


def test_compaction_puts_each_partition_into_one_directory(spark, warehouse):
    rows = lambda a, b: spark.sql(f"SELECT id, timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id % 5 AS INT)) AS ts FROM range({a}, {b})")
    warehouse.create("t", rows(0, 20), Layout(rules=(time_partition("ts"),)))
    for n in range(3):
        warehouse.append("t", rows(100 * n + 100, 100 * n + 110))
    inc.merge(warehouse, "t", rows(3, 4), "id")
    before = as_rows(warehouse.read("t"))
    assert len(warehouse.manifest("t").segments) == 20 and len(warehouse.compact("t").segments) == 5
    assert as_rows(warehouse.read("t")) == before
    version = warehouse.manifest("t").version
    assert warehouse.compact("t").version == version
