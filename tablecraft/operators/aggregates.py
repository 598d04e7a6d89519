"""Grouped aggregates over a stored table, kept up to date from its changes.

A stored aggregate holds one row per group: how many rows it has, and per measure what can
be added to and taken away from. A refresh compares the directories and files that the table
lists now with those it listed at the last refresh, and reads only what was added and what
was taken away; a merge that rewrote two files costs those two. Counts and sums add up with
signs. A least or greatest value is lost if the removed rows held it and the added ones do not
hold one as good; only the groups with such a loss are looked up in the whole table.

The groups that come out different replace their stored rows, in the same manifest that
names the version of the table they answer for, so a refresh is seen whole or not at all.
Everything is built anew if the table was replaced or its columns changed their
meaning, or if what it listed then is no longer there.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablecraft.operators.layout import Layout
from tablecraft.sources.warehouse import Manifest, TableError, Warehouse, numbered, touched_files

ROWS = "__rows"
GROUP = ("__group", "__group_check")
#: Property of the stored aggregate: the version of the table that it answers for.
SEEN = "aggregated_version"


@dataclass(frozen=True)
class Measure:
    """``kind`` of a SQL expression over the table's columns."""

    kind: str
    of: str


def count(of: str = "1") -> Measure:
    """Rows in which the expression is not null."""
    return Measure("count", of)


def total(of: str) -> Measure:
    """Sum of an integral or decimal expression; null without values."""
    return Measure("total", of)


def least(of: str) -> Measure:
    return Measure("least", of)


def greatest(of: str) -> Measure:
    return Measure("greatest", of)


_ENDS: dict[str, tuple[Callable, Callable]] = {"least": (F.min, F.least), "greatest": (F.max, F.greatest)}


@dataclass(frozen=True)
class Aggregate:
    """``SELECT keys, measures FROM table WHERE where GROUP BY keys``."""

    table: str
    keys: Mapping[str, str]
    measures: Mapping[str, Measure]
    where: str | None = None

    def problems(self) -> list[str]:
        names = [n.lower() for n in (*self.keys, *self.measures)]
        out = [] if self.keys and self.measures else ["an aggregate needs a key and a measure"]
        if len(set(names)) < len(names):
            out.append("keys and measures need different names")
        out += [f"names that begin with '__' are kept: {n}" for n in names if n.startswith("__")]
        out += [f"unknown kind '{m.kind}' of measure '{n}'" for n, m in self.measures.items() if m.kind not in ("count", "total", *_ENDS)]
        return out

    # -- computing ---------------------------------------------------------------
    def named(self, rows: DataFrame) -> DataFrame:
        """Rows with the group's name, its keys and every measure's value."""
        chosen = rows if self.where is None else rows.where(self.where)
        keys = [F.expr(e).alias(n) for n, e in self.keys.items()]
        values = [F.expr(m.of).alias(f"{n}__value") for n, m in self.measures.items()]
        found = chosen.select(*keys, *values)
        for n, m in self.measures.items():
            kind = found.schema[f"{n}__value"].dataType
            if m.kind == "total" and not isinstance(kind, (T.IntegralType, T.DecimalType)):
                raise TableError(f"total '{n}' of {kind.simpleString()}: only integral and decimal values can be taken away again; cast to DECIMAL")
        # Hashes of keys skip nulls, so which keys are null is hashed, too.
        parts = [p for n in self.keys for p in (F.col(f"`{n}`"), F.col(f"`{n}`").isNull())]
        return found.withColumns({g: F.xxhash64(F.lit(i), *parts) for i, g in enumerate(GROUP)})

    def _partials(self, rows: DataFrame, sign: Column | None) -> DataFrame:
        """One row per group; with a sign, least and greatest apart for added and removed rows."""
        out = [F.first(F.col(f"`{k}`")).alias(k) for k in self.keys]
        one = sign if sign is not None else F.lit(1).cast("long")
        out.append(F.sum(one).alias(ROWS))
        for n, m in self.measures.items():
            value = F.col(f"`{n}__value`")
            if m.kind in ("count", "total"):
                out.append(F.sum(F.when(value.isNotNull(), one).otherwise(0)).alias(f"{n}__n"))
            if m.kind == "total":
                kind = rows.schema[f"{n}__value"].dataType
                wide = T.DecimalType(38, kind.scale if isinstance(kind, T.DecimalType) else 0)
                signed = value if sign is None else F.when(sign > 0, value.cast(wide)).otherwise(-value.cast(wide))
                out.append(F.sum(signed.cast(wide)).cast(wide).alias(f"{n}__sum"))
            if m.kind in _ENDS:
                end = _ENDS[m.kind][0]
                if sign is None:
                    out.append(end(value).alias(f"{n}__end"))
                else:
                    out += [end(F.when(sign > 0, value)).alias(f"{n}__in"), end(F.when(sign < 0, value)).alias(f"{n}__out")]
        return rows.groupBy(*GROUP).agg(*out)

    def partials(self, rows: DataFrame) -> DataFrame:
        """What is stored: one row per group of ``rows``."""
        return self._partials(self.named(rows), None)

    def result(self, stored: DataFrame) -> DataFrame:
        """The aggregate as readers see it."""
        out = [F.col(f"`{k}`") for k in self.keys]
        for n, m in self.measures.items():
            if m.kind == "count":
                out.append(F.col(f"`{n}__n`").alias(n))
            elif m.kind == "total":
                out.append(F.when(F.col(f"`{n}__n`") > 0, F.col(f"`{n}__sum`")).alias(n))
            else:
                out.append(F.col(f"`{n}__end`").alias(n))
        return stored.select(*out)

    def whole(self, rows: DataFrame) -> DataFrame:
        """The aggregate computed from all rows."""
        return self.result(self.partials(rows))

    def changed(self, stored: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
        """Stored rows of the groups that change, as they will be, with ``__lost`` where an end must be looked up.

        Groups that no row is left of have 0 ``__rows``.
        """
        sign = F.col("__sign")
        moves = self.named(added).withColumn("__sign", F.lit(1).cast("long")).unionByName(self.named(removed).withColumn("__sign", F.lit(-1).cast("long")))
        delta = self._partials(moves, sign).alias("d")
        joined = delta.join(stored.alias("s"), list(GROUP), "left")
        old = lambda c: F.coalesce(F.col(f"s.`{c}`"), F.lit(0))
        there = F.col(f"s.{ROWS}").isNotNull()
        out = [*GROUP, *[F.coalesce(F.col(f"s.`{k}`"), F.col(f"d.`{k}`")).alias(k) for k in self.keys]]
        out.append((old(ROWS) + F.col(f"d.{ROWS}")).alias(ROWS))
        differs, lost = F.col(f"d.{ROWS}") != 0, F.lit(False)
        for n, m in self.measures.items():
            for c in (f"{n}__n", f"{n}__sum"):
                if c in delta.columns:
                    kind = stored.schema[c].dataType
                    out.append((old(c).cast(kind) + F.coalesce(F.col(f"d.`{c}`"), F.lit(0)).cast(kind)).cast(kind).alias(c))
                    differs = differs | (F.coalesce(F.col(f"d.`{c}`"), F.lit(0)) != 0)
            if m.kind in _ENDS:
                best = _ENDS[m.kind][1]
                was, come, gone = F.col(f"s.`{n}__end`"), F.col(f"d.`{n}__in`"), F.col(f"d.`{n}__out`")
                held = gone.isNotNull() & (best(gone, was) == gone)
                made_good = come.isNotNull() & (best(come, was) == come)
                gap = there & was.isNotNull() & held & ~made_good
                lost = lost | gap
                new = best(was, come)
                out.append(new.alias(f"{n}__end"))
                differs = differs | gap | ~new.eqNullSafe(was)
        return joined.where(differs | ~there).select(*out, lost.alias("__lost"))

    def ends(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """(group, ends) of some groups, from all rows of the table."""
        ends = [_ENDS[m.kind][0](F.col(f"`{n}__value`")).alias(f"{n}__found") for n, m in self.measures.items() if m.kind in _ENDS]
        return self.named(rows).join(groups, list(GROUP), "left_semi").groupBy(*GROUP).agg(*ends)


def listed_changes(warehouse: Warehouse, old: Manifest, new: Manifest) -> tuple[list[str], list[str]]:
    """Segments of a table (added, removed) between two versions, down to files where a directory lost some."""
    gone, come = set(old.segments) - set(new.segments), set(new.segments) - set(old.segments)
    for s in sorted(gone | come):
        if s.endswith(".parquet"):
            continue
        inside = {c for c in gone | come if c.startswith(f"{s}/") and c.endswith(".parquet")}
        if inside:
            leaves = warehouse.files.child_files(f"{warehouse._folder(old.table)}/{s}")
            files = {f"{s}/{leaf}" for leaf in leaves if leaf.endswith(".parquet")}
            for side in (gone, come):
                if s in side:
                    side.remove(s)
                    side |= files
    same = gone & come
    return sorted(come - same), sorted(gone - same)


def _same_meaning(old: Manifest, new: Manifest) -> bool:
    """Whether every column of the old version still reads the same stored values."""
    now = {c.name.lower(): (c.stored_as, c.type, c.existing_value) for c in new.columns}
    return all(now.get(c.name.lower(), (c.stored_as, c.type, c.existing_value)) == (c.stored_as, c.type, c.existing_value) for c in old.columns)


def build(warehouse: Warehouse, name: str, view: Aggregate, layout: Layout | None = None, properties: Mapping[str, Any] | None = None, run_ts=None) -> Manifest:
    """Store the aggregate of the table's present version."""
    source = warehouse.manifest(view.table)
    rows = warehouse.read(view.table, version=source.version, guarded=False)
    return warehouse.create(name, view.partials(rows), layout=layout, properties={**(properties or {}), SEEN: source.version}, run_ts=run_ts)


def refresh(warehouse: Warehouse, name: str, view: Aggregate, properties: Mapping[str, Any] | None = None) -> Manifest | None:
    """Bring a stored aggregate up to the table's present version; None if it must be built anew."""
    base = warehouse.manifest(name)
    new = warehouse.manifest(view.table)
    seen = base.properties.get(SEEN)
    properties = {**base.properties, **(properties or {}), SEEN: new.version}
    if seen == new.version:
        return warehouse.commit(base, properties=properties)
    try:
        old = warehouse.manifest(view.table, seen)
    except TableError:
        return None
    kept = {s.split("/", 1)[0] for s in old.segments} & {s.split("/", 1)[0] for s in new.segments}
    if not kept or not _same_meaning(old, new):
        return None
    added, removed = listed_changes(warehouse, old, new)
    folder = warehouse._folder(view.table)
    if not all(warehouse.files.exists(f"{folder}/{s}") for s in removed):
        return None
    read = lambda m, segments: warehouse.read(view.table, version=m.version, segments=segments, guarded=False)
    stored = warehouse.read(name, version=base.version, guarded=False)
    with warehouse.staged(view.changed(stored, read(new, added), read(old, removed))) as changed:
        lost = changed.where(F.col("__lost") & (F.col(ROWS) > 0)).select(*GROUP)
        rows = changed.where(F.col(ROWS) > 0).drop("__lost")
        if not lost.isEmpty():
            everything = warehouse.read(view.table, version=new.version, guarded=False)
            found = view.ends(everything, lost)
            joined = changed.where(F.col(ROWS) > 0).join(found, list(GROUP), "left")
            ends = {f"{n}__end": F.when(F.col("__lost"), F.col(f"`{n}__found`")).otherwise(F.col(f"`{n}__end`")) for n, m in view.measures.items() if m.kind in _ENDS}
            rows = joined.withColumns(ends).select(*stored.columns)
        return _replaced(warehouse, base, changed.select(*GROUP), rows, properties)


def _replaced(warehouse: Warehouse, base: Manifest, groups: DataFrame, rows: DataFrame, properties: Mapping[str, Any]) -> Manifest:
    """Publish ``rows`` in place of the stored rows of ``groups``; files without them stay."""
    located = numbered(warehouse.read(base.table, version=base.version, located=True, guarded=False))
    touched = touched_files(located.join(groups, list(GROUP), "left_semi"), located)
    if not touched and groups.isEmpty():
        return warehouse.commit(base, properties=properties)
    if touched:
        old = warehouse.read(base.table, version=base.version, segments=list(touched), guarded=False)
        rows = old.join(groups, list(GROUP), "left_anti").unionByName(rows.select(*old.columns))
    return warehouse.publish(base, rows, replaced=list(touched), properties=properties)
