"""Aggregates kept up to date from the changes of their table."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import aggregates
from tablecraft.operators import incremental as inc
from tablecraft.operators.aggregates import Aggregate
from tablecraft.operators.layout import Layout, PartitionRule
from tablecraft.plans.project import Project, ProjectError
from tablecraft.sources.warehouse import TableError
from tests.conftest import as_rows

SCHEMA = "id long, place string, value int, price decimal(10,2), day date"
VIEW = Aggregate(
    "t", {"place": "place", "even": "value % 2 = 0"},
    {"n": aggregates.count(), "valued": aggregates.count("value"), "sum": aggregates.total("price"), "small": aggregates.total("value"),
     "low": aggregates.least("value"), "high": aggregates.greatest("price"), "last": aggregates.greatest("day")},
    where="coalesce(value, 0) >= 0")


def rows_of(rng, ids):
    return [(i, rng.choice(("a", "b", "c", None)), rng.choice((None, -1, *range(9))), rng.choice((None, 1, 5, 7)) and rng.randrange(900) / 4,
             dt.date(2024, 1, 1 + rng.randrange(20))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame([(i, p, v, None if x is None else __import__("decimal").Decimal(str(x)), d) for i, p, v, x, d in rows], SCHEMA)


def agree(warehouse, view=VIEW, name="v"):
    whole = view.whole(warehouse.read(view.table))
    found = view.result(warehouse.read(name))
    assert as_rows(found) == as_rows(whole)
    assert [f.dataType for f in found.schema] == [f.dataType for f in whole.schema]
    return found


@pytest.fixture
def recorded(warehouse, monkeypatch):
    """Every segment that is read of table ``t``."""
    seen = []
    read = warehouse.read

    def reading(name, *args, segments=None, version=None, **more):
        if name == "t":
            seen.append(list(segments if segments is not None else warehouse.manifest(name, version).segments))
        return read(name, *args, segments=segments, version=version, **more)

    monkeypatch.setattr(warehouse, "read", reading)
    return seen


@pytest.mark.parametrize("layout", [Layout(), Layout(rules=(PartitionRule("column", "day", "day"),))])
def test_any_sequence_of_changes(spark, warehouse, layout):
    rng = random.Random(repr(layout))
    warehouse.create("t", frame(spark, rows_of(rng, range(60))), layout)
    aggregates.build(warehouse, "v", VIEW)
    agree(warehouse)
    for step in range(5):
        ids = [rng.randrange(100) for _ in range(rng.choice((1, 5, 20)))]
        rows = frame(spark, rows_of(rng, sorted(set(ids))))
        kind = step % 4
        if kind == 0:
            warehouse.append("t", frame(spark, rows_of(rng, range(200 + 10 * step, 206 + 10 * step))))
        elif kind == 1:
            inc.merge(warehouse, "t", rows, "id")
        elif kind == 2:
            inc.delete_insert(warehouse, "t", rows, "id")
        else:
            base = warehouse.manifest("t")
            warehouse.publish(base, warehouse.read("t").limit(0), replaced=base.segments[:1])
        if step % 3 < 2:  # also two changes before one refresh
            assert aggregates.refresh(warehouse, "v", VIEW) is not None or kind == 3
            if warehouse.manifest("v").properties[aggregates.SEEN] == warehouse.manifest("t").version:
                agree(warehouse)


def test_only_what_changed_is_read(spark, warehouse, recorded):
    rows = [(i, "abc"[i % 3], i % 9, 1.0, dt.date(2024, 1, 1 + i % 10)) for i in range(90)]
    warehouse.create("t", frame(spark, rows), Layout(rules=(PartitionRule("column", "day", "day"),)))
    aggregates.build(warehouse, "v", VIEW)
    before = set(warehouse.manifest("t").segments)
    inc.merge(warehouse, "t", frame(spark, [(11, "c", 2, 3.0, dt.date(2024, 1, 2))]), "id")
    changed = before ^ set(warehouse.manifest("t").segments)
    recorded.clear()
    assert aggregates.refresh(warehouse, "v", VIEW) is not None
    assert recorded and {s for segments in recorded for s in segments} <= changed and len(changed) < 4
    # What was not changed is not even needed to be there.
    root = f"{warehouse.root}/t"
    for s in before & set(warehouse.manifest("t").segments):
        shutil.rmtree(f"{root}/{s}")
    warehouse.append("t", frame(spark, [(500, "a", 1, 2.0, dt.date(2024, 1, 3))]))
    assert aggregates.refresh(warehouse, "v", VIEW) is not None
    stored = {(r["place"], r["even"]): r for r in VIEW.result(warehouse.read("v")).collect()}
    assert stored["a", False]["n"] == 1 + sum(r[1] == "a" and r[2] % 2 == 1 for r in rows)


def test_lost_ends_are_looked_up_for_their_groups_alone(spark, warehouse, monkeypatch):
    view = Aggregate("t", {"place": "place"}, {"low": aggregates.least("value"), "high": aggregates.greatest("value")})
    rows = [(i, "ab"[i % 2], i, 1.0, dt.date(2024, 1, 1)) for i in range(20)]
    warehouse.create("t", frame(spark, rows))
    aggregates.build(warehouse, "v", view)
    asked = []
    ends = Aggregate.ends
    monkeypatch.setattr(Aggregate, "ends", lambda self, rows, groups: (asked.append(groups.count()), ends(self, rows, groups))[1])
    inc.merge(warehouse, "t", frame(spark, [(4, "a", 7, 1.0, dt.date(2024, 1, 1))]), "id")
    aggregates.refresh(warehouse, "v", view)
    assert asked == [] and agree(warehouse, view).count() == 2
    inc.merge(warehouse, "t", frame(spark, [(0, "a", 9, 1.0, dt.date(2024, 1, 1))]), "id")
    aggregates.refresh(warehouse, "v", view)
    assert asked == [1] and {r["place"]: r["low"] for r in agree(warehouse, view).collect()} == {"a": 2, "b": 1}


def test_untouched_groups_are_not_rewritten(spark, warehouse):
    view = Aggregate("t", {"place": "place"}, {"n": aggregates.count()})
    warehouse.create("t", frame(spark, [(i, f"p{i}", 1, 1.0, dt.date(2024, 1, 1)) for i in range(50)]))
    first = aggregates.build(warehouse, "v", view)
    inc.merge(warehouse, "t", frame(spark, [(3, "p3", 8, 8.0, dt.date(2024, 1, 1))]), "id")  # counts stay
    assert aggregates.refresh(warehouse, "v", view).segments == first.segments
    agree(warehouse, view)
    warehouse.append("t", frame(spark, [(77, "new", 8, 8.0, dt.date(2024, 1, 1))]))
    assert set(first.segments) < set(aggregates.refresh(warehouse, "v", view).segments)
    agree(warehouse, view)


def test_built_anew_when_changes_cannot_be_told(spark, warehouse):
    warehouse.create("t", frame(spark, rows_of(random.Random(1), range(30))))
    aggregates.build(warehouse, "v", VIEW)
    warehouse.create("t", frame(spark, rows_of(random.Random(2), range(30))))
    assert aggregates.refresh(warehouse, "v", VIEW) is None
    aggregates.build(warehouse, "v", VIEW)
    warehouse.append("t", frame(spark, rows_of(random.Random(3), range(9))))
    gone = f"{warehouse.root}/t/_manifests/{2:020d}.json"
    warehouse.files.delete(gone)
    assert aggregates.refresh(warehouse, "v", VIEW) is None


def test_sums_of_floats_are_refused(spark, warehouse):
    warehouse.create("t", spark.createDataFrame([(1, 2.5)], "id long, x double"))
    with pytest.raises(TableError, match="cast to DECIMAL"):
        aggregates.build(warehouse, "v", Aggregate("t", {"id": "id"}, {"s": aggregates.total("x")}))
    kept = Aggregate("t", {"id": "id"}, {"low": aggregates.least("x"), "s": aggregates.total("CAST(x AS DECIMAL(9,2))")})
    aggregates.build(warehouse, "v", kept)
    warehouse.append("t", spark.createDataFrame([(1, float("nan")), (2, float("-inf"))], "id long, x double").where("NOT isnan(x) AND x > -10 OR id = 2 AND false"))
    aggregates.refresh(warehouse, "v", kept)
    agree(warehouse, kept)


def test_declared_in_a_project(spark, warehouse):
    made = Project(spark, warehouse)
    start = dt.datetime(2024, 1, 1)
    warehouse.create("t", frame(spark, rows_of(random.Random(5), range(40))))
    made.aggregate_view("v", VIEW, enable_refresh=True, refresh_interval_minutes=60)
    assert made.refresh_if_stale("v", start)
    warehouse.append("t", frame(spark, rows_of(random.Random(6), range(100, 120))))
    assert not made.refresh_if_stale("v", start + dt.timedelta(minutes=59))
    assert made.refresh_if_stale("v", start + dt.timedelta(minutes=61))
    assert as_rows(made.read("v")) == as_rows(VIEW.whole(warehouse.read("t")))
    assert {r["place"] for r in made.read("v", where=[("place", "==", "a")]).collect()} == {"a"}
    assert made.consumers("t").unique_keys == []

    @made.model(materialized="table")
    def above(ctx):
        return ctx.ref("v").groupBy("place").agg(F.sum("n").alias("n"))

    made.run("above")
    assert made.read("above").count() == made.read("v").select("place").distinct().count()
    # A changed definition is built whole.
    made.aggregate_view("v", Aggregate("t", {"place": "place"}, {"n": aggregates.count()}))
    made.run("v")
    assert made.read("v").columns == ["place", "n"]
    with pytest.raises(ProjectError, match="needs a key and a measure"):
        made.aggregate_view("w", Aggregate("t", {}, {"n": aggregates.count()}))
    with pytest.raises(ProjectError, match="different names"):
        made.aggregate_view("w", Aggregate("t", {"n": "place"}, {"n": aggregates.count()}))
