"""History rules, checked against a row-by-row model of the statements."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import snapshot as scd
from tests.conftest import as_rows

DDL = "id int, v string, at timestamp_ntz"
T = [dt.datetime(2024, m, 1) for m in range(1, 7)]


def day(n):
    return None if n is None else dt.datetime(2023, 1, 1) + dt.timedelta(days=n)


def frame(spark, rows):
    return spark.createDataFrame([(k, v, day(u)) for k, v, u in rows], DDL)


class RowModel:
    """Close, insert, hard-delete, one row at a time."""

    def __init__(self):
        self.rows = []

    def run(self, source, ts, hard):
        source = [(k, v, day(u)) for k, v, u in source]
        if not self.rows and not hasattr(self, "started"):
            self.started = True
            self.rows = [[*s, ts, None] for s in source]
            return
        for row in self.rows:
            newer = any(
                s[0] == row[0] and row[0] is not None and s[2] is not None and row[2] is not None and s[2] > row[2]
                for s in source
            )
            if row[4] is None and newer:
                row[4] = ts
        still_open = {r[0] for r in self.rows if r[4] is None and r[0] is not None}
        self.rows += [[*s, ts, None] for s in source if s[0] is None or s[0] not in still_open]
        if hard:
            keys = {s[0] for s in source}
            for row in self.rows:
                if row[4] is None and (not source or (None not in keys and row[0] is not None and row[0] not in keys)):
                    row[4] = ts

    def result(self):
        return sorted(map(tuple, self.rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


COLUMNS = ("id", "v", "at", "dbt_valid_from", "dbt_valid_to")


def check(spark, warehouse, runs, hard, auto_optimize=True):
    model = RowModel()
    history = None
    name = f"h{random.randrange(10**9)}"
    for ts, rows in zip(T, runs, strict=False):
        source = frame(spark, rows)
        model.run(rows, ts, hard)
        if history is None:
            history = scd.snapshot_init(source, "id", "at", ts)
        else:
            history = scd.snapshot_apply(history, source, "id", "at", ts, invalidate_hard_deletes=hard)
        scd.snapshot_run(
            warehouse, name, source, "id", "at", ts, invalidate_hard_deletes=hard, auto_optimize=auto_optimize
        )
        history = warehouse.stage(history)
    assert as_rows(history, *COLUMNS) == model.result()
    assert as_rows(warehouse.read(name), *COLUMNS) == model.result()
    return model.result()


@pytest.mark.parametrize("hard", [False, True])
@pytest.mark.parametrize(
    "runs",
    [
        # changed, unchanged, new
        [[(1, "a", 1), (2, "b", 1)], [(1, "A", 2), (2, "b", 1), (3, "c", 2)]],
        # gone, then back with the same timestamp
        [[(1, "a", 1), (2, "b", 1)], [(1, "a", 1)], [(1, "a", 1), (2, "b", 1)]],
        # NULL timestamps never count as newer
        [[(1, "a", None), (2, "b", 1)], [(1, "A", 2), (2, "B", None)]],
        # NULL keys come in again on every run
        [[(None, "a", 1), (1, "b", 1)], [(None, "a", 1)]],
        [[(1, "a", 1), (2, "b", 1)], [(None, "x", 1)]],
        # an empty source
        [[(1, "a", 1), (None, "n", 1)], []],
        # several rows of a key
        [[(1, "a", 1)], [(1, "b", 1), (1, "c", 3)], [(1, "b", 1), (1, "c", 3)]],
    ],
)
def test_rules(spark, warehouse, runs, hard):
    check(spark, warehouse, runs, hard)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_runs(spark, warehouse, seed):
    rng = random.Random(seed)
    runs = [
        [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice("abc"), rng.choice([None, 1, 2, 3, 4])) for _ in range(rng.randrange(6))]
        for _ in range(4)
    ]
    check(spark, warehouse, runs, hard=bool(seed % 2), auto_optimize=bool(seed % 2))


def test_rerun_adds_nothing(spark, warehouse):
    source = frame(spark, [(1, "a", 1), (2, "b", 1)])
    scd.snapshot_run(warehouse, "h", source, "id", "at", T[0])
    first = as_rows(warehouse.read("h"))
    scd.snapshot_run(warehouse, "h", source, "id", "at", T[1], invalidate_hard_deletes=True)
    assert as_rows(warehouse.read("h")) == first


def test_returned_key_has_the_same_version_id(spark, warehouse):
    rows = [(1, "a", 1), (2, "b", 1)]
    for ts, source in zip(T, [rows, rows[:1], rows], strict=False):
        scd.snapshot_run(warehouse, "h", frame(spark, source), "id", "at", ts, invalidate_hard_deletes=True)
    twice = warehouse.read("h").where("id = 2").select("dbt_scd_id").collect()
    assert len(twice) == 2
    assert twice[0] == twice[1]


def test_version_id_text(spark):
    import hashlib

    row = frame(spark, [(7, "a", 1)]).select(scd.scd_id("id", "at")).first()
    assert row[0] == hashlib.md5(b"7|2023-01-02 00:00:00").hexdigest()
    assert frame(spark, [(7, "a", None)]).select(scd.scd_id("id", "at")).first()[0] is None


def test_new_column_goes_before_the_bookkeeping(spark, warehouse):
    scd.snapshot_run(warehouse, "h", frame(spark, [(1, "a", 1)]), "id", "at", T[0])
    wider = frame(spark, [(1, "b", 2)]).selectExpr("id", "v", "at", "'x' AS extra")
    scd.snapshot_run(warehouse, "h", wider, "id", "at", T[1])
    assert warehouse.read("h").columns == ["id", "v", "at", "extra", *scd.BOOKKEEPING]
    assert as_rows(warehouse.read("h"), "v", "extra") == [("a", None), ("b", "x")]
    # A column that the source loses stays and is NULL from then on.
    scd.snapshot_run(warehouse, "h", frame(spark, [(1, "c", 3)]), "id", "at", T[2])
    assert as_rows(warehouse.read("h").where("v = 'c'"), "extra") == [(None,)]


def test_closed_directories_are_only_added_to(spark, warehouse):
    rows = [(i, "a", 1) for i in range(6)]
    scd.snapshot_run(warehouse, "h", frame(spark, rows), "id", "at", T[0])
    scd.snapshot_run(warehouse, "h", frame(spark, [(0, "b", 2), *rows[1:]]), "id", "at", T[1])
    closed = {s for s in warehouse.manifest("h").segments if "_open=false" in s}
    assert len(closed) == 1
    scd.snapshot_run(warehouse, "h", frame(spark, [(0, "c", 3), *rows[1:]]), "id", "at", T[2])
    assert closed < {s for s in warehouse.manifest("h").segments if "_open=false" in s}


def test_refusals(spark, warehouse):
    with_null = frame(spark, [(None, "a", 1)])
    with pytest.raises(scd.SnapshotError, match="NULL key"):
        scd.snapshot_run(warehouse, "h", with_null, "id", "at", T[0], null_keys="reject")
    with pytest.raises(scd.SnapshotError, match="no column 'nope'"):
        scd.snapshot_run(warehouse, "h", with_null, "nope", "at", T[0])
    with pytest.raises(scd.SnapshotError, match="unknown snapshot strategy"):
        scd.snapshot_run(warehouse, "h", with_null, "id", "at", T[0], strategy="check")
    with pytest.raises(scd.SnapshotError, match="clash"):
        scd.snapshot_init(with_null.withColumnRenamed("v", "DBT_valid_to"), "id", "at", T[0])


def test_one_changed_key_keeps_all_open_files_but_its_own(spark, warehouse):
    def rows(newer):
        at = F.when(F.col("id") == newer, F.lit("2024-02-01")).otherwise("2024-01-01").cast("timestamp_ntz")
        return spark.range(0, 8000, 1, 8).select("id", at.alias("at"))

    def files():
        return {r[0] for r in warehouse.read("h", located=True).where("dbt_valid_to IS NULL").select("__file").distinct().collect()}

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files of a few rows
    scd.snapshot_run(warehouse, "h", rows(-1), "id", "at", dt.datetime(2024, 1, 5))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    before = files()
    assert len(before) >= 4
    scd.snapshot_run(warehouse, "h", rows(77), "id", "at", dt.datetime(2024, 2, 5))
    assert len(before - files()) == 1
    assert warehouse.read("h").count() == 8001 and warehouse.read("h").where("dbt_valid_to IS NULL").count() == 8000
