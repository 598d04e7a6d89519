"""Tables stored along a curve through several columns."""

import datetime as dt
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablecraft.operators import curve
from tablecraft.operators.layout import Layout, LayoutError, PartitionRule, scan
from tablecraft.sources.warehouse import Manifest
from tests.conftest import as_rows


@pytest.fixture
def many_files(spark):
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def groups_read(warehouse, name, column, low, high):
    """Share of row groups whose range of ``column`` meets [low, high]."""
    hit = all_ = 0
    for path in glob.glob(f"{warehouse.root.removeprefix('file:')}/{name}/__version=*/**/*.parquet", recursive=True):
        meta = pq.read_metadata(path)
        at = meta.schema.names.index(column)
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            all_ += 1
            hit += stats.min <= high and stats.max >= low
    return hit / all_


def rows(spark):
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000))
    # Skewed and differently scaled; a third of all rows share one value of b.
    return spark.range(40_000).select(
        "id", (h(1) / 7.0).alias("a"), F.when(F.col("id") % 3 == 0, 500).otherwise((h(2) * h(2) / 1000).cast("int")).alias("b"),
        F.date_add(F.lit("2024-01-01").cast("date"), (h(3) % 900).cast("int")).alias("c"), F.concat(F.lit("k"), F.lpad(h(4).cast("string"), 5, "0")).alias("d"))


@pytest.mark.parametrize("columns, filters", [
    (("a", "b"), {"a": (100, 120), "b": (40_000, 50_000)}),
    (("c", "d"), {"c": (dt.date(2024, 5, 1), dt.date(2024, 5, 20)), "d": ("k04000", "k04200")}),
])
def test_a_filter_on_any_column_reads_few_row_groups(spark, warehouse, many_files, columns, filters):
    data = rows(spark)
    warehouse.create("curved", data, Layout(cluster_by=columns, curve=True))
    warehouse.create("sorted", data, Layout(cluster_by=columns))
    second = columns[1]
    assert groups_read(warehouse, "curved", second, *filters[second]) < 1 / 3 < groups_read(warehouse, "sorted", second, *filters[second])
    for column, (low, high) in filters.items():
        assert groups_read(warehouse, "curved", column, low, high) < 0.4
        found = scan(warehouse, "curved", [(column, "between", (low, high))])
        assert as_rows(found) == as_rows(data.where(F.col(column).between(F.lit(low), F.lit(high))))


def test_order_within_directories_and_manifest(spark, warehouse):
    layout = Layout(rules=(PartitionRule("column", "p", "p"),), cluster_by=("a", "b"), curve=True)
    data = rows(spark).limit(500).withColumn("p", (F.col("id") % 3).cast("int"))
    made = warehouse.create("t", data, layout)
    assert Manifest.from_text(made.to_text()).layout.curve and warehouse.manifest("t").layout == layout
    assert as_rows(warehouse.read("t")) == as_rows(data)
    warehouse.append("t", data)
    assert warehouse.read("t").count() == 1000
    old = Layout(cluster_by=("a",)).to_json()
    del old["curve"]
    assert Layout.from_json(old) == Layout(cluster_by=("a",))


def test_odd_values(spark, warehouse):
    kinds = "a double, b string, c timestamp, d timestamp_ntz, e boolean, f decimal(30,2), g array<int>"
    data = spark.createDataFrame([
        (None, None, None, None, None, None, None), (float("nan"), "", dt.datetime(1, 1, 2), dt.datetime(9999, 12, 31), True, None, [1]), (float("-inf"), "ﬁ\U0001F600", None, None, False, None, [])], kinds)
    assert curve.bounds(data, ["g"]) == {} and set(curve.bounds(data, data.columns)) == set("abcdef")
    warehouse.create("t", data, Layout(cluster_by=("g", "b", "c", "d"), curve=True))
    assert warehouse.read("t").count() == 3
    warehouse.create("none", data.limit(0), Layout(cluster_by=("a", "b"), curve=True))
    assert warehouse.read("none").count() == 0
    with pytest.raises(LayoutError, match="two or more"):
        Layout(cluster_by=("a",), curve=True)


def test_places_interleave_ranks(spark):
    data = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    places = {(r["x"], r["y"]): r["z"] for r in data.select("x", "y", curve.position(data, ["x", "y"], bits=3).alias("z")).collect()}
    assert sorted(places.values()) == list(range(64))
    assert {p // 16 for (x, y), p in places.items() if x < 4 and y < 4} == {0}
