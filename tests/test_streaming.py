import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import snapshot as scd
from tablecraft.sources.warehouse import ConcurrentWriteError
from tablecraft.streaming.microbatch import _once, read_new_files, stream_identity, stream_incremental, stream_snapshot
from tests.conftest import as_rows


def test_new_files_only_and_restart(spark, warehouse, tmp_path):
    arriving, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(arriving)
        stream = read_new_files(spark, arriving, "id bigint")
        stream_incremental(stream, warehouse, "t", checkpoint).awaitTermination()
        assert warehouse.read("t").count() == (n + 1) * 10
    assert warehouse.manifest("t").batches == {stream_identity(warehouse, checkpoint): 2}


def test_two_streams_and_a_new_checkpoint_lose_nothing(spark, warehouse, tmp_path):
    def feed(source, checkpoint, first):
        spark.range(first, first + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / source))
        stream = read_new_files(spark, str(tmp_path / source), "id bigint")
        stream_incremental(stream, warehouse, "t", str(tmp_path / checkpoint)).awaitTermination()

    feed("a", "ck-a", 0)
    feed("b", "ck-b", 100)
    feed("a", "ck-a", 5)
    assert sorted(r["id"] for r in warehouse.read("t").collect()) == [*range(10), *range(100, 105)]
    feed("c", "ck-new", 200)
    assert warehouse.read("t").count() == 20 and len(warehouse.manifest("t").batches) == 3


def test_a_batch_id_survives_another_stream_in_between(spark, warehouse):
    base = warehouse.create("t", spark.range(1), batches={"a": 0})
    second = warehouse.append("t", spark.range(1), batches={"b": 0})
    assert second.batches == {"a": 0, "b": 0}
    with pytest.raises(ConcurrentWriteError):
        warehouse.publish(base, spark.range(1), replaced=(), batches={"a": 1})


def test_a_replayed_batch_is_skipped(spark, warehouse):
    def work(batch, batch_id, batches):
        if warehouse.exists("t"):
            warehouse.append("t", batch, batches=batches)
        else:
            warehouse.create("t", batch, batches=batches)

    handle = _once(warehouse, "t", lambda: "s", work)
    other = _once(warehouse, "t", lambda: "other", work)
    handle(spark.range(3), 0)
    handle(spark.range(3), 0)
    assert warehouse.read("t").count() == 3
    handle(spark.range(3), 1)
    other(spark.range(3), 0)
    assert warehouse.read("t").count() == 9
    assert warehouse.manifest("t").batches == {"s": 1, "other": 0}


def test_merge_strategies(spark, warehouse, tmp_path):
    for strategy in ("merge", "delete+insert"):
        arriving = str(tmp_path / strategy)
        for n in range(2):
            spark.range(n, n + 2).withColumn("v", F.lit(n)).coalesce(1).write.mode("append").parquet(arriving)
            stream = read_new_files(spark, arriving, "id bigint, v int")
            stream_incremental(stream, warehouse, strategy.replace("+", "_"), arriving + "-ck", strategy, "id").awaitTermination()
        assert as_rows(warehouse.read(strategy.replace("+", "_"))) == [(0, 0), (1, 1), (2, 1)]


def test_snapshot_batches(spark, warehouse, tmp_path):
    arriving = str(tmp_path / "in")
    clock = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]
    for n in range(2):
        rows = spark.sql(f"SELECT id, timestamp_ntz'2023-01-01' + make_dt_interval({n}) AS at FROM range({2 - n})")
        rows.coalesce(1).write.mode("append").parquet(arriving)
        stream_snapshot(
            read_new_files(spark, arriving, rows.schema), warehouse, "h", arriving + "-ck", "id", "at", clock=clock.__getitem__
        ).awaitTermination()
    assert as_rows(warehouse.read("h"), "id", "dbt_valid_from", "dbt_valid_to") == [
        (0, clock[0], clock[1]), (0, clock[1], None), (1, clock[0], None),
    ]
    assert set(scd.BOOKKEEPING) < set(warehouse.read("h").columns)
