"""Edge rules of the incremental strategies, pure and table forms alike."""

import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import incremental as inc
from tablecraft.operators.layout import Layout, date_partition, range_partition, time_partition
from tablecraft.sources.warehouse import FILE, TableError, touched_files
from tests.conftest import as_rows

DDL = "k int, v string"
PURE = {
    "merge": lambda t, s: inc.merge_frames(t, s, "k"),
    "insert_only": lambda t, s: inc.insert_only_frames(t, s, "k"),
    "delete_insert": lambda t, s: inc.delete_insert_frames(t, s, "k"),
    "append": inc.append_frames,
}
STORED = {
    "merge": lambda w, n, s: inc.merge(w, n, s, "k"),
    "insert_only": lambda w, n, s: inc.insert_only(w, n, s, "k"),
    "delete_insert": lambda w, n, s: inc.delete_insert(w, n, s, "k"),
    "append": inc.append,
}


def both(spark, warehouse, strategy, target, source, layout=None):
    """The result of the pure form, after checking that the table form agrees."""
    t, s = spark.createDataFrame(target, DDL), spark.createDataFrame(source, DDL)
    pure = as_rows(PURE[strategy](t, s))
    warehouse.create("t", t, layout)
    STORED[strategy](warehouse, "t", s)
    assert as_rows(warehouse.read("t")) == pure
    return pure


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize(
    ("strategy", "target", "source", "wanted"),
    [
        ("merge", [(1, "a"), (2, "b")], [(2, "B"), (3, "C")], [(1, "a"), (2, "B"), (3, "C")]),
        ("merge", [], [(1, "a"), (1, "b")], [(1, "a"), (1, "b")]),
        ("merge", [(1, "a")], [], [(1, "a")]),
        # A NULL key matches nothing: the row is inserted again.
        ("merge", [(None, "a")], [(None, "b")], [(None, "a"), (None, "b")]),
        # Two stored rows of one key are both updated.
        ("merge", [(1, "a"), (1, "b")], [(1, "C")], [(1, "C"), (1, "C")]),
        # NULL values are values.
        ("merge", [(1, "a")], [(1, None)], [(1, None)]),
        # Duplicates of an unmatched key are all inserted.
        ("merge", [(1, "a")], [(2, "x"), (2, "y")], [(1, "a"), (2, "x"), (2, "y")]),
        ("insert_only", [(1, "a")], [(1, "A"), (2, "b"), (None, "n")], [(1, "a"), (2, "b"), (None, "n")]),
        ("insert_only", [(1, "a")], [(1, "x"), (1, "y")], [(1, "a")]),
        ("delete_insert", [(1, "a"), (1, "b"), (2, "c")], [(1, "x"), (1, "y")], [(1, "x"), (1, "y"), (2, "c")]),
        ("delete_insert", [(None, "a"), (2, "b")], [(None, "x")], [(None, "a"), (None, "x"), (2, "b")]),
        ("delete_insert", [], [(1, "a"), (1, "a")], [(1, "a"), (1, "a")]),
        ("delete_insert", [(1, "a")], [], [(1, "a")]),
        ("append", [(1, "a")], [(1, "a"), (1, "b")], [(1, "a"), (1, "a"), (1, "b")]),
    ],
)
def test_rules(spark, warehouse, strategy, target, source, wanted):
    assert both(spark, warehouse, strategy, target, source) == ordered(wanted)


def test_random_states_against_row_by_row_rules(spark, warehouse):
    """Partitioned tables, NULL keys, duplicates; each strategy by hand in Python."""
    rng = random.Random(7)
    keys = [None, 0, 1, 2, 3, 4, 5, 6, 7]
    for _ in range(3):
        target = [(rng.choice(keys), rng.choice("abc")) for _ in range(12)]
        source = [(rng.choice(keys), rng.choice("xyz")) for _ in range(5)]
        unique = list({k: (k, v) for k, v in source}.values())
        have = {k for k, _ in target if k is not None}
        new = dict(u for u in unique if u[0] is not None)
        merged = [(k, new.get(k, v)) if k is not None else (k, v) for k, v in target]
        merged += [(k, v) for k, v in unique if k not in have]
        layout = Layout(rules=(range_partition("k", 0, 6, 2),))
        assert both(spark, warehouse, "merge", target, unique, layout) == ordered(merged)
        hit = {k for k, _ in source if k is not None}
        assert both(spark, warehouse, "delete_insert", target, source, layout) == ordered(
            [t for t in target if t[0] not in hit] + source
        )


def test_two_source_rows_for_a_stored_row_fail(spark, warehouse):
    t = spark.createDataFrame([(1, "a")], DDL)
    s = spark.createDataFrame([(1, "x"), (1, "y")], DDL)
    with pytest.raises(Exception, match="several source rows match the key"):
        inc.merge_frames(t, s, "k").collect()
    warehouse.create("t", t)
    with pytest.raises(inc.MergeCardinalityError):
        inc.merge(warehouse, "t", s, "k")
    assert as_rows(warehouse.read("t")) == [(1, "a")]
    assert as_rows(inc.duplicate_matches(t, s, "k")) == [(1, 2)]


def test_merge_twice_is_merge_once(spark, warehouse):
    s = spark.createDataFrame([(1, "x"), (5, "y")], DDL)
    warehouse.create("t", spark.createDataFrame([(1, "a"), (2, "b")], DDL))
    inc.merge(warehouse, "t", s, "k")
    once = as_rows(warehouse.read("t"))
    inc.merge(warehouse, "t", s, "k")
    assert as_rows(warehouse.read("t")) == once


def test_composite_key_with_a_null_part(spark, warehouse):
    ddl = "a int, b int, v string"
    t = spark.createDataFrame([(1, 1, "p"), (1, None, "q")], ddl)
    s = spark.createDataFrame([(1, 1, "P"), (1, None, "Q")], ddl)
    wanted = ordered([(1, 1, "P"), (1, None, "q"), (1, None, "Q")])
    assert as_rows(inc.merge_frames(t, s, ["a", "b"])) == wanted
    warehouse.create("t", t)
    inc.merge(warehouse, "t", s, ["a", "b"])
    assert as_rows(warehouse.read("t")) == wanted


def test_columns_match_by_name_in_any_case(spark, warehouse):
    warehouse.create("t", spark.createDataFrame([(1, "a")], DDL))
    inc.merge(warehouse, "t", spark.createDataFrame([("B", 1), ("C", 2)], "V string, K int"), "K")
    assert as_rows(warehouse.read("t")) == [(1, "B"), (2, "C")]


def test_merge_needs_all_columns(spark, warehouse):
    warehouse.create("t", spark.createDataFrame([(1, "a")], DDL))
    with pytest.raises(TableError, match="lacks v"):
        inc.merge(warehouse, "t", spark.createDataFrame([(1,)], "k int"), "k")
    with pytest.raises(TableError, match="key column 'k'"):
        inc.merge(warehouse, "t", spark.createDataFrame([("x",)], "v string"), "k")


def test_only_touched_directories_are_rewritten(spark, warehouse):
    days = spark.sql("SELECT id AS k, timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id AS INT)) AS ts FROM range(30)")
    warehouse.create("t", days, Layout(rules=(time_partition("ts", "DAY"),)))
    before = set(warehouse.manifest("t").segments)
    inc.merge(warehouse, "t", days.where("k IN (3, 4)").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")), "k")
    after = set(warehouse.manifest("t").segments)
    assert len(before - after) == 2
    assert len(after - before) == 2
    assert warehouse.read("t").count() == 30
    # A row that moves to another day leaves its old directory.
    inc.merge(warehouse, "t", days.where("k = 7").withColumn("ts", F.lit("2024-06-01").cast("timestamp_ntz")), "k")
    assert warehouse.read("t").count() == 30
    assert warehouse.read("t").where("k = 7").first()["ts"].month == 6


def test_partition_columns_among_the_keys_prune_the_target(spark, warehouse, monkeypatch):
    days = spark.sql("SELECT id AS k, timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id AS INT)) AS ts, 'a' AS v FROM range(20)")
    warehouse.create("t", days, Layout(rules=(time_partition("ts", "DAY"),)))
    read = warehouse.read
    seen = []

    def spy(*args, **options):
        seen.append(options.get("segments"))
        return read(*args, **options)

    monkeypatch.setattr(warehouse, "read", spy)
    source = days.where("k IN (3, 4)").withColumn("v", F.lit("b")).unionByName(days.limit(1).withColumn("k", F.lit(99).cast("bigint")))
    inc.merge(warehouse, "t", source, ["k", "ts"])
    assert len(seen[0]) == 3
    monkeypatch.undo()
    assert warehouse.read("t").where("v = 'b'").count() == 2
    assert warehouse.read("t").count() == 21
    # Values outside a range layout share the overflow directory.
    warehouse.create("r", spark.range(-3, 12).withColumn("v", F.lit("a")), Layout(rules=(range_partition("id", 0, 9, 3),)))
    inc.merge(warehouse, "r", spark.sql("SELECT -2L AS id, 'b' AS v UNION ALL SELECT 10L, 'b' UNION ALL SELECT 4L, 'b'"), "id")
    assert as_rows(warehouse.read("r").where("v = 'b'"), "id") == [(-2,), (10,), (4,)]
    assert warehouse.read("r").count() == 15
    inc.delete_insert(warehouse, "r", spark.sql("SELECT CAST(NULL AS BIGINT) AS id, 'n' AS v"), "id")
    assert warehouse.read("r").count() == 16


def test_the_key_range_reaches_the_scan(spark, warehouse):
    warehouse.create("t", spark.range(100).withColumn("v", F.lit("a")))
    base = warehouse.manifest("t")
    plan = inc._possible_matches(warehouse, base, spark.range(40, 50), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,40)" in plan
    assert "LessThanOrEqual(id,49)" in plan


def test_matches_carry_file_numbers_instead_of_paths(spark, warehouse):
    """Directories with characters that paths escape; files are found by their numbers."""
    rows = [(i, v) for i, v in enumerate(("a b", "a%2Fb+c", "ü/x", None, "q=1:2#?", "plain"))]
    warehouse.create("t", spark.createDataFrame(rows, DDL), Layout(rules=(date_partition("v"),)))
    base = warehouse.manifest("t")
    here = inc._possible_matches(warehouse, base, spark.createDataFrame(rows, DDL), ["k"])
    assert here.dtypes == [("k", "int"), (FILE, "bigint")]
    located = warehouse.read("t", located=True)
    for k, v in rows:
        found = touched_files(here.where(F.col("k") == k), here, F.col("k"))
        name = located.where(F.col("k") == k).first()[FILE]
        assert list(found) == [unquote(name[name.index("/__version=") + 1:])] and list(found.values()) == [k]
    inc.delete_insert(warehouse, "t", spark.createDataFrame([(k, "new") for k, _ in rows[:5]], DDL), "k")
    assert as_rows(warehouse.read("t")) == ordered([*((k, "new") for k, _ in rows[:5]), (5, "plain")])
    assert len([s for s in warehouse.manifest("t").segments if s in base.segments]) == 1


def test_a_hot_key_is_kept_whole(spark, warehouse):
    """A third of target and source rows share one key, another part has none."""
    target = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit("a").alias("v"))
    warehouse.create("t", target)
    source = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") + 29_000).alias("k"), F.lit("b").alias("v"))
    both_ways = [inc.merge_frames(target, source.dropDuplicates(["k"]).unionByName(spark.sql("SELECT 0L AS k, 'c' AS v")), "k")]
    inc.merge(warehouse, "t", source.dropDuplicates(["k"]).unionByName(spark.sql("SELECT 0L AS k, 'c' AS v")), "k")
    both_ways.append(warehouse.read("t"))
    for got in both_ways:
        assert got.where("v = 'c'").count() == 10_000
        assert got.count() == 30_000 + 6_000 - 333 + 1
    inc.delete_insert(warehouse, "t", source, "k")
    assert warehouse.read("t").where("k IS NULL").count() == 3_000 + 1


def test_insert_only_rewrites_nothing(spark, warehouse):
    warehouse.create("t", spark.createDataFrame([(1, "a")], DDL))
    before = warehouse.manifest("t").segments
    inc.insert_only(warehouse, "t", spark.createDataFrame([(1, "z"), (2, "b")], DDL), "k")
    assert set(before) <= set(warehouse.manifest("t").segments)
    assert as_rows(warehouse.read("t")) == [(1, "a"), (2, "b")]


def test_source_is_evaluated_once(spark, warehouse):
    warehouse.create("t", spark.createDataFrame([(1, "a"), (2, "b")], DDL))
    random_rows = spark.range(50).select(F.col("id").cast("int").alias("k"), F.uuid().alias("v"))
    inc.merge(warehouse, "t", random_rows, "k")
    assert warehouse.read("t").count() == 50
    assert warehouse.read("t").select("v").distinct().count() == 50


def test_high_water_mark_reads_the_newest_directory(spark, warehouse):
    days = spark.sql("SELECT id, timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id AS INT)) AS ts FROM range(40)")
    warehouse.create("t", days, Layout(rules=(time_partition("ts", "MONTH"),)))
    assert inc.high_water_mark(warehouse, "t", "ts").isoformat() == "2024-02-09T00:00:00"
    assert inc.high_water_mark(warehouse, "t", "id") == 39
    warehouse.create("e", days.where("id < 0"))
    assert inc.high_water_mark(warehouse, "e", "ts") is None
    assert inc.newer_than(days, "ts", None).count() == 0


def test_unknown_strategy(spark, warehouse):
    warehouse.create("t", spark.range(1))
    with pytest.raises(ValueError, match="unknown incremental strategy"):
        inc.apply_strategy(warehouse, "t", spark.range(1), "upsert", "id")
    with pytest.raises(ValueError, match="needs a unique_key"):
        inc.apply_strategy(warehouse, "t", spark.range(1), "merge")
