"""Slowly changing dimension (type 2) history of a query.

Four bookkeeping columns follow the source columns. A row is open while
``dbt_valid_to`` is NULL. Each run closes rows whose source is newer, inserts
source rows that have no open row, and optionally closes rows whose key is
gone, all with one clock value.

Keys compare with plain ``=``: a NULL key matches nothing, so it is inserted on
every run and never closed, and a NULL key in the source keeps every row from
being closed as deleted (``NOT IN`` semantics). ``null_keys='reject'`` refuses
such sources instead.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablecraft.operators import digests as dg
from tablecraft.operators.aggregates import listed_changes
from tablecraft.operators.layout import Layout, PartitionRule, literal, time_partition
from tablecraft.sources.warehouse import (
    FILE, Manifest, Warehouse, columns_of, numbered, touched_files,
)

# The bookkeeping columns of a history table.
SCD_ID = "dbt_scd_id"
UPDATED_AT = "dbt_updated_at"
VALID_FROM = "dbt_valid_from"
VALID_TO = "dbt_valid_to"
BOOKKEEPING = (SCD_ID, UPDATED_AT, VALID_FROM, VALID_TO)
STRATEGIES = ("timestamp",)

_SEEN = "__seen"
_NEWEST = "__newest"


class SnapshotError(ValueError):
    """A source that cannot be versioned."""


def scd_id(key: Column | str, updated_at: Column | str) -> Column:
    """Version id: hex md5 of key and timestamp text with a bar between them.

    NULL if either is NULL.
    """
    k = F.col(key) if isinstance(key, str) else key
    u = F.col(updated_at) if isinstance(updated_at, str) else updated_at
    return F.md5(F.concat(k.cast("string"), F.lit("|"), u.cast("string")).cast("binary"))


def _clock_type(source: DataFrame, updated_at: str) -> T.DataType:
    kind = source.schema[_name(source, updated_at)].dataType
    return kind if isinstance(kind, T.TimestampNTZType) else T.TimestampType()


def _name(df: DataFrame, wanted: str) -> str:
    for c in df.columns:
        if c.lower() == wanted.lower():
            return c
    raise SnapshotError(f"source has no column '{wanted}'; it has: {', '.join(df.columns)}")


def _versions(source: DataFrame, key: str, updated_at: str, run_ts: dt.datetime) -> DataFrame:
    clash = [c for c in source.columns if c.lower() in BOOKKEEPING]
    if clash:
        raise SnapshotError(f"source columns clash with bookkeeping columns: {', '.join(clash)}")
    clock = _clock_type(source, updated_at)
    ts = F.col(f"`{_name(source, updated_at)}`")
    return source.select(
        "*",
        scd_id(F.col(f"`{_name(source, key)}`"), ts).alias(SCD_ID),
        ts.alias(UPDATED_AT),
        literal(run_ts, clock).alias(VALID_FROM),
        F.lit(None).cast(clock).alias(VALID_TO),
    )


def snapshot_init(source: DataFrame, key: str, updated_at: str, run_ts: dt.datetime) -> DataFrame:
    """The first history: every source row open since ``run_ts``."""
    return _versions(source, key, updated_at, run_ts)


def snapshot_adapt(history: DataFrame, source: DataFrame) -> DataFrame:
    """Add source columns that the history lacks (NULL for old versions)."""
    have = {c.lower() for c in history.columns}
    data = [F.col(f"`{c}`") for c in history.columns if c.lower() not in BOOKKEEPING]
    new = [
        F.lit(None).cast(f.dataType).alias(f.name)
        for f in source.schema.fields
        if f.name.lower() not in have
    ]
    return history.select(*data, *new, *BOOKKEEPING)


def _newest(source: DataFrame, key: str, updated_at: str) -> DataFrame:
    """One row per non-NULL key; a hot key collapses before the shuffle."""
    return (
        source.where(F.col(f"`{key}`").isNotNull())
        .groupBy(F.col(f"`{key}`").alias("__key"))
        .agg(F.max(F.col(f"`{updated_at}`")).alias(_NEWEST), F.lit(True).alias(_SEEN))
    )


def _changed() -> Column:
    return F.coalesce(F.col(_NEWEST) > F.col(UPDATED_AT), F.lit(False))


def _gone(key: Column, source_empty: Column, source_has_null_key: Column) -> Column:
    absent = F.col(_SEEN).isNull() & key.isNotNull() & ~source_has_null_key
    return source_empty | absent


def _flag(rows: DataFrame, newest: DataFrame, key: str) -> DataFrame:
    return rows.alias("h").join(newest.alias("n"), F.col(f"h.`{key}`") == F.col("n.__key"), "left").drop("__key")


def snapshot_close(
    history: DataFrame, source: DataFrame, key: str, updated_at: str, run_ts: dt.datetime
) -> DataFrame:
    """Only the closing step: open rows with a newer source row end at ``run_ts``."""
    return _step(history, source, key, updated_at, run_ts, insert=False, hard_deletes=False)


def snapshot_apply(
    history: DataFrame,
    source: DataFrame,
    key: str,
    updated_at: str,
    run_ts: dt.datetime,
    invalidate_hard_deletes: bool = False,
) -> DataFrame:
    """The history after one run: close, insert, optionally close deleted keys.

    Closed rows pass through without a shuffle.
    """
    return _step(history, source, key, updated_at, run_ts, insert=True, hard_deletes=invalidate_hard_deletes)


def _step(history, source, key, updated_at, run_ts, insert: bool, hard_deletes: bool) -> DataFrame:
    key, updated_at = _name(source, key), _name(source, updated_at)
    history = snapshot_adapt(history, source)
    clock = history.schema[VALID_TO].dataType
    is_open = F.col(VALID_TO).isNull()
    flagged = _flag(history.where(is_open), _newest(source, key, updated_at), key)
    ends = _changed()
    if hard_deletes:
        facts = source.agg(
            (F.count(F.lit(1)) == 0).alias("empty"),
            (F.count_if(F.col(f"`{key}`").isNull()) > 0).alias("null_key"),
        )
        ends = ends | _gone(F.col(f"`{key}`"), facts.select("empty").scalar(), facts.select("null_key").scalar())
    stepped = flagged.withColumn(VALID_TO, F.when(ends, literal(run_ts, clock))).drop(_NEWEST, _SEEN)
    result = history.where(~is_open).unionByName(stepped)
    if insert:
        remaining = flagged.where(~_changed()).select(F.col(f"`{key}`"))
        fresh = source.alias("s").join(
            remaining.alias("r"), F.col(f"s.`{key}`") == F.col(f"r.`{key}`"), "left_anti"
        )
        result = result.unionByName(_versions(fresh, key, updated_at, run_ts), allowMissingColumns=True)
    return result


# -- table form ------------------------------------------------------------------------
def history_layout(key: str, auto_optimize: bool = True) -> Layout:
    """Open rows apart from closed ones, each by start date, clustered by key.

    Closed directories are only ever added to. Readers see neither level.
    """
    if not auto_optimize:
        return Layout()
    open_rows = PartitionRule("is_null", VALID_TO, "_open")
    return Layout(rules=(open_rows, time_partition(VALID_FROM, "DAY")), cluster_by=(key,))


def snapshot_run(
    warehouse: Warehouse,
    name: str,
    source: DataFrame,
    key: str,
    updated_at: str,
    run_ts: dt.datetime,
    invalidate_hard_deletes: bool = False,
    auto_optimize: bool = True,
    null_keys: str = "allow",
    strategy: str = "timestamp",
    digests: bool = False,
    **changes: Any,
) -> Manifest:
    """One run against a stored history; the first run creates it.

    Files without a closing row are neither read in full nor rewritten. With
    ``digests`` open rows are not even read where they agree with the source
    (see :mod:`tablecraft.operators.digests`).
    """
    if strategy not in STRATEGIES:
        raise SnapshotError(f"unknown snapshot strategy '{strategy}'; use {', '.join(STRATEGIES)}")
    if null_keys not in ("allow", "reject"):
        raise SnapshotError("null_keys must be 'allow' or 'reject'")
    key, updated_at = _name(source, key), _name(source, updated_at)
    with warehouse.staged(source) as rows:
        if digests and warehouse.exists(name):
            return _run_by_digest(warehouse, name, rows, key, updated_at, run_ts, invalidate_hard_deletes, null_keys, changes)
        return _run_rows(
            warehouse, name, rows, key, updated_at, run_ts, invalidate_hard_deletes, auto_optimize, null_keys, changes
        )


def _run_rows(
    warehouse, name, rows, key, updated_at, run_ts, invalidate_hard_deletes, auto_optimize, null_keys, changes, at=None, facts=None
) -> Manifest:
    empty, null_key = facts or (False, False)
    if facts is not None:
        pass
    elif invalidate_hard_deletes or null_keys == "reject":
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(f"`{key}`").isNull()).alias("nulls")).first()
        empty, null_key = facts["n"] == 0, facts["nulls"] > 0
        if null_key and null_keys == "reject":
            raise SnapshotError(f"snapshot '{name}': {facts['nulls']} source rows have a NULL key")
    if not warehouse.exists(name):
        return warehouse.create(
            name, snapshot_init(rows, key, updated_at, run_ts), history_layout(key, auto_optimize), **changes
        )

    base = _widened(warehouse.manifest(name), rows)
    candidates = _open_segments(warehouse, base)
    is_open = F.col(VALID_TO).isNull()
    run_time = literal(run_ts, base.column(VALID_TO).data_type)
    opened = (
        numbered(warehouse.read(name, version=base.version, segments=candidates, located=True, guarded=False))
        .where(is_open if at is None else is_open & at)
        .select(F.col(f"`{key}`").alias("__open"), F.col(UPDATED_AT).alias("__dated"), FILE)
    )
    if empty and invalidate_hard_deletes:
        touched = list(touched_files(opened, opened))
        old = warehouse.read(name, version=base.version, segments=touched, guarded=False)
        closed = old.withColumn(VALID_TO, F.when(is_open, run_time).otherwise(F.col(VALID_TO)))
        return warehouse.publish(base, closed, replaced=touched, **changes)

    # NULL keys match nothing and never close: they stay out of the joins.
    opened = opened.where(F.col("__open").isNotNull())
    delta = _delta(opened, _newest(rows, key, updated_at), invalidate_hard_deletes and not null_key).persist()
    try:
        closing = delta.where("NOT new").select("__key", _NEWEST, "gone")
        ending = opened.join(closing, F.col("__open") == F.col("__key")).where(F.col("gone") | (F.col(_NEWEST) > F.col("__dated")))
        touched = list(touched_files(ending, opened))
        fresh = _without_open_row(rows, delta, closing, opened, key)
        result = _versions(fresh, key, updated_at, run_ts)
        if touched:
            old = warehouse.read(name, version=base.version, segments=touched, guarded=False)
            ends = F.coalesce(F.col("gone") | (F.col(_NEWEST) > F.col(UPDATED_AT)), F.lit(False))
            stepped = (
                old.join(closing, F.col(f"`{key}`") == F.col("__key"), "left")
                .withColumn(VALID_TO, F.when(is_open & ends, run_time).otherwise(F.col(VALID_TO)))
                .drop("__key", _NEWEST, "gone")
            )
            result = stepped.unionByName(result, allowMissingColumns=True)
        return warehouse.publish(base, _with_all_columns(result, base), replaced=touched, **changes)
    finally:
        delta.unpersist()


def _run_by_digest(warehouse, name, rows, key, updated_at, run_ts, invalidate_hard_deletes, null_keys, changes) -> Manifest:
    """A run over the buckets whose digests differ; the next digests come from what it closes and opens."""
    base = warehouse.manifest(name)
    k, ts = base.column(key).data_type, base.column(UPDATED_AT).data_type
    times = rows.select(F.col(f"`{key}`").cast(k).alias("k"), F.col(f"`{updated_at}`").cast(ts).alias("t"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(f"`{key}`").isNull()).alias("nulls")).first()
    if facts["nulls"] and null_keys == "reject":
        raise SnapshotError(f"snapshot '{name}': {facts['nulls']} source rows have a NULL key")
    segments = _open_segments(warehouse, base)
    opened = warehouse.read(name, version=base.version, segments=segments, guarded=False).where(F.col(VALID_TO).isNull()).select(F.col(f"`{key}`").alias("k"), F.col(UPDATED_AT).alias("t"))
    before = dg.stored(warehouse, base, segments, key, opened)
    with warehouse.staged(before) as before:
        unequal = dg.differing(before, dg.digest(times))
        widened = len(_widened(base, rows).columns) > len(base.columns)
        if not unequal and not facts["nulls"] and not widened and facts["n"]:
            properties = base.properties
            if (properties.get(dg.PROPERTY) or {}).get("of") != dg.fingerprint(segments):
                properties = {**properties, dg.PROPERTY: dg.named(dg.keep(warehouse, base, before), key, segments)}
            return warehouse.commit(base, properties=properties, **changes)
        if len(unequal) <= dg.BUCKETS // 2 and facts["n"]:
            within = F.col(f"`{key}`").isNull() | dg.bucket(F.col(f"`{key}`").cast(k)).isin(unequal)
            some, at = rows.where(within), dg.bucket(F.col(f"`{key}`")).isin(unequal)
        else:
            some, at = rows, F.lit(True)
        done = _run_rows(
            warehouse, name, some, key, updated_at, run_ts, invalidate_hard_deletes, True, null_keys, changes, at=at,
            facts=(facts["n"] == 0, facts["nulls"] > 0))
        # What the run closed and opened is in the files it replaced and added.
        after = _open_segments(warehouse, done)
        came, went = ([s for s in side if _is_open_segment(warehouse, base, s)] for side in listed_changes(warehouse, base, done))

        def times_of(manifest: Manifest, chosen: list[str]) -> DataFrame:
            read = warehouse.read(name, version=manifest.version, segments=chosen, guarded=False).where(F.col(VALID_TO).isNull())
            return read.select(F.col(f"`{key}`").alias("k"), F.col(UPDATED_AT).alias("t"))

        now = dg.added(before, dg.digest(times_of(base, went), -1), dg.digest(times_of(done, came)))
        folder = dg.keep(warehouse, done, now)
        return warehouse.commit(done, properties={**done.properties, dg.PROPERTY: dg.named(folder, key, after)})


def _is_open_segment(warehouse: Warehouse, base: Manifest, segment: str) -> bool:
    rule = next((r for r in base.layout.rules if r.kind == "is_null"), None)
    return rule is None or warehouse.directory_value(segment, rule.column) == "true"


def _open_segments(warehouse: Warehouse, base: Manifest) -> list[str]:
    return [s for s in base.segments if _is_open_segment(warehouse, base, s)]


def _delta(opened: DataFrame, newest: DataFrame, hard_deletes: bool) -> DataFrame:
    """What a run changes: keys with an open row that ends, and keys without an open row.

    One join of two narrow sides with a row per key, so a key with many open rows
    is no task of its own; the result is the increment, so the joins of whole rows
    against it are against a small side unless much has changed.
    """
    opened = opened.groupBy("__open").agg(F.min("__dated").alias("__dated"))
    changed = F.coalesce(F.col(_NEWEST) > F.col("__dated"), F.lit(False))
    gone = F.col(_SEEN).isNull() if hard_deletes else F.lit(False)
    joined = opened.join(newest, F.col("__open") == F.col("__key"), "full_outer" if hard_deletes else "right")
    return joined.select(
        F.coalesce("__key", "__open").alias("__key"), _NEWEST, F.col("__open").isNull().alias("new"), gone.alias("gone"),
        changed.alias("changed"),
    ).where("new OR gone OR changed")


def _without_open_row(rows: DataFrame, delta: DataFrame, closing: DataFrame, opened: DataFrame, key: str) -> DataFrame:
    """Source rows whose key keeps no open row: new keys, changed keys, NULL keys."""
    k = F.col(f"`{key}`")
    still_open = (
        opened.join(closing.where("NOT gone"), F.col("__open") == F.col("__key"))
        .where(~F.coalesce(F.col(_NEWEST) > F.col("__dated"), F.lit(False)))
        .select("__open")
    )
    found = delta.where("NOT gone").select("__key").distinct()
    wanted = found.join(still_open, F.col("__key") == F.col("__open"), "left_anti")
    keyed = rows.alias("s").join(wanted.alias("w"), F.col(f"s.`{key}`") == F.col("w.__key"), "left_semi")
    return keyed.unionByName(rows.where(k.isNull()))


def _widened(base: Manifest, source: DataFrame) -> Manifest:
    """Declare source columns the history lacks, before the bookkeeping ones."""
    have = {c.name.lower() for c in base.columns}
    new = [c for c in columns_of(source.schema) if c.name.lower() not in have]
    if not new:
        return base
    used = set(base.used_names)
    named = [replace(c, stored_as=c.name if c.name.lower() not in used else f"{c.name}_{base.version + 1}") for c in new]
    data = [c for c in base.columns if c.name.lower() not in BOOKKEEPING]
    tail = [c for c in base.columns if c.name.lower() in BOOKKEEPING]
    return replace(
        base,
        columns=(*data, *named, *tail),
        used_names=(*base.used_names, *[c.stored_as.lower() for c in named]),
    )


def _with_all_columns(df: DataFrame, base: Manifest) -> DataFrame:
    have = {c.lower() for c in df.columns}
    missing: Sequence[Column] = [
        F.lit(None).cast(c.data_type).alias(c.name) for c in base.columns if c.name.lower() not in have
    ]
    return df.select("*", *missing)
