"""Snapshot runs by digests equal plain ones and join only what differs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import digests as dg
from tablecraft.operators import snapshot as scd
from tests.conftest import as_rows

SCHEMA = "id long, changed timestamp_ntz, v long"
START = dt.datetime(2024, 1, 1)


def extracts(rng, runs, nulls=False):
    rows = {k: (START, k) for k in range(60)}
    for n in range(runs):
        out = [(k, t, v) for k, (t, v) in rows.items()] + ([(None, START, n)] if nulls else [])
        yield out + rng.sample(out, 3) if n == 2 else out
        for k in rng.sample(sorted(rows), 4):
            kind = rng.randrange(4)
            if kind == 0:
                del rows[k]
            elif kind == 1:
                rows[k] = (START + dt.timedelta(hours=n + 1), rows[k][1] + 100)
            elif kind == 2:
                rows[k] = (START - dt.timedelta(hours=1), 7)
            else:
                rows[1000 + 10 * n + kind] = (START, n)


@pytest.mark.parametrize("hard", [True, False])
@pytest.mark.parametrize("nulls", [True, False])
def test_histories_are_the_same(spark, warehouse, hard, nulls):
    for n, rows in enumerate(extracts(random.Random(hard + 2 * nulls), 4, nulls)):
        source = spark.createDataFrame(rows, SCHEMA)
        for name, by in (("plain", False), ("digests", True)):
            scd.snapshot_run(warehouse, name, source, "id", "changed", START + dt.timedelta(days=n), invalidate_hard_deletes=hard, digests=by)
        assert as_rows(warehouse.read("digests")) == as_rows(warehouse.read("plain"))
        base = warehouse.manifest("digests")
        if n and hard:
            segments = scd._open_segments(warehouse, base)
            opened = warehouse.read("digests").where("dbt_valid_to is null").select("id", "dbt_updated_at")
            assert base.properties[dg.PROPERTY]["of"] == dg.fingerprint(segments)
            assert dg.differing(dg.stored(warehouse, base, segments, "id", opened.limit(0)), dg.digest(opened)) == []


def test_unchanged_run_reads_no_history(spark, warehouse, monkeypatch):
    source = spark.range(50_000).select("id", F.lit(START).cast("timestamp_ntz").alias("changed"), F.col("id").alias("v"))
    for n in range(2):
        scd.snapshot_run(warehouse, "h", source, "id", "changed", START + dt.timedelta(days=n), digests=True)
    before = warehouse.manifest("h")
    runs, opened = [], []
    run, digest = scd._run_rows, dg.digest
    monkeypatch.setattr(scd, "_run_rows", lambda *a, **k: (runs.append(a[2].count()), run(*a, **k))[1])
    monkeypatch.setattr(dg, "digest", lambda rows, *a: (opened.append(any("/h/" in f for f in rows.inputFiles())), digest(rows, *a))[1])
    scd.snapshot_run(warehouse, "h", source, "id", "changed", START + dt.timedelta(days=3), digests=True, invalidate_hard_deletes=True)
    assert runs == [] and opened == [False]
    assert warehouse.manifest("h").segments == before.segments
    # One changed key: its bucket alone goes into the joins.
    later = source.withColumn("changed", F.when(F.col("id") == 77, F.lit(START + dt.timedelta(hours=1)).cast("timestamp_ntz")).otherwise(F.col("changed")))
    scd.snapshot_run(warehouse, "h", later, "id", "changed", START + dt.timedelta(days=4), digests=True)
    assert 1 <= runs[0] < 50 and warehouse.read("h").count() == 50_001


def test_an_empty_extract_closes_all(spark, warehouse):
    source = spark.createDataFrame([(1, START, 1), (2, START, 2)], SCHEMA)
    scd.snapshot_run(warehouse, "h", source, "id", "changed", START, digests=True)
    scd.snapshot_run(warehouse, "h", source.limit(0), "id", "changed", START + dt.timedelta(days=1), digests=True, invalidate_hard_deletes=True)
    assert warehouse.read("h").where("dbt_valid_to is null").count() == 0
    scd.snapshot_run(warehouse, "h", source, "id", "changed", START + dt.timedelta(days=2), digests=True, invalidate_hard_deletes=True)
    assert warehouse.read("h").count() == 4


def test_another_writer_is_noticed(spark, warehouse):
    source = spark.createDataFrame([(1, START, 1), (2, START, 2)], SCHEMA)
    for n in range(2):
        scd.snapshot_run(warehouse, "h", source, "id", "changed", START + dt.timedelta(days=n), digests=True)
    base = warehouse.manifest("h")
    warehouse.publish(base, warehouse.read("h").where("id = 1"), replaced=base.segments)  # key 2 is gone from the history
    scd.snapshot_run(warehouse, "h", source, "id", "changed", START + dt.timedelta(days=5), digests=True)
    assert as_rows(warehouse.read("h").where("dbt_valid_to is null"), "id") == [(1,), (2,)]


def test_digests_are_order_free_and_add_up(spark):
    rows = [(k, START + dt.timedelta(minutes=k % 7)) for k in range(300)] + [(5, None), (None, START)]
    make = lambda r: dg.digest(spark.createDataFrame(r, "k long, t timestamp_ntz"))
    assert dg.differing(make(rows), make(rows[::-1])) == []
    assert dg.differing(dg.added(make(rows[:100]), make(rows[100:])), make(rows)) == []
    assert len(dg.differing(make(rows), make(rows[1:]))) == 1
    assert dg.added(make(rows), dg.digest(spark.createDataFrame(rows, "k long, t timestamp_ntz"), -1)).isEmpty()
