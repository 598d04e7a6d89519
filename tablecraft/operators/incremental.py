"""Incremental strategies: high-water mark, merge, delete+insert, append.

Each strategy has a pure form over DataFrames and a table form. The table
forms find out first which files hold matching keys (reading only the key
columns of the target) and rewrite only those.

Keys compare with plain ``=``: a NULL key matches nothing, so such rows are
inserted again by merge and never deleted by delete+insert.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablecraft.operators import keyindex
from tablecraft.operators.layout import PartitionRule, literal
from tablecraft.sources.warehouse import FILE, NULL_DIRECTORY, Manifest, TableError, Warehouse, numbered, touched_files

_MATCH = "__match"
STRATEGIES = ("merge", "delete+insert", "append")
_RANGED = (T.IntegralType, T.DateType, T.TimestampNTZType, T.TimestampType, T.StringType)


class MergeCardinalityError(RuntimeError):
    """A target row is matched by more than one source row."""


def _keys(unique_key: str | Sequence[str]) -> list[str]:
    keys = [unique_key] if isinstance(unique_key, str) else list(unique_key)
    if not keys:
        raise ValueError("give at least one key column")
    return keys


def _on(left: str, right: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{left}.`{k}`") == F.col(f"{right}.`{k}`") for k in keys]


def _with_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(f"`{k}`").isNotNull())
    return df


# -- pure forms ------------------------------------------------------------------
def merge_frames(target: DataFrame, source: DataFrame, unique_key: str | Sequence[str], update: bool = True) -> DataFrame:
    """Target after MERGE: update matched rows, insert the others.

    Source keys are grouped once (partial aggregation collapses a hot
    duplicate before the shuffle); a matched key with several source rows
    raises when the plan runs.
    """
    keys = _keys(unique_key)
    if not update or _all_keys(target, keys):
        return target.unionByName(_unmatched(source, target, keys))
    values = [c for c in target.columns if c.lower() not in {k.lower() for k in keys}]
    single = (
        _with_key(source, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.first(F.struct(*[F.col(f"`{v}`") for v in values])).alias(_MATCH),
        )
    )
    message = F.concat(F.lit("merge: several source rows match the key "), F.to_json(F.struct(*[F.col(f"s.`{k}`") for k in keys])))
    guarded = F.when(F.col("s.__n") > 1, F.raise_error(message).cast(single.schema[_MATCH].dataType)).otherwise(
        F.col(f"s.{_MATCH}")
    )
    joined = target.alias("t").join(single.alias("s"), _on("t", "s", keys), "left").select("t.*", guarded.alias(_MATCH))
    updated = joined.select(
        *[
            F.when(F.col(_MATCH).isNotNull(), F.col(_MATCH)[c]).otherwise(F.col(f"`{c}`")).alias(c)
            if c in values
            else F.col(f"`{c}`")
            for c in target.columns
        ]
    )
    return updated.unionByName(_unmatched(source, target, keys))


def _all_keys(target: DataFrame, keys: Sequence[str]) -> bool:
    return {c.lower() for c in target.columns} == {k.lower() for k in keys}


def _unmatched(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    have = target.select(*[F.col(f"`{k}`") for k in keys])
    return source.alias("s").join(have.alias("t"), _on("s", "t", keys), "left_anti")


def insert_only_frames(target: DataFrame, source: DataFrame, unique_key: str | Sequence[str]) -> DataFrame:
    """Target plus the source rows whose key it does not have; no update."""
    return merge_frames(target, source, unique_key, update=False)


def delete_insert_frames(target: DataFrame, source: DataFrame, unique_key: str | Sequence[str]) -> DataFrame:
    """Target without the keys of the source, plus all source rows."""
    keys = _keys(unique_key)
    kept = target.alias("t").join(
        source.select(*[F.col(f"`{k}`") for k in keys]).alias("s"), _on("t", "s", keys), "left_anti"
    )
    return kept.unionByName(source)


def append_frames(target: DataFrame, source: DataFrame) -> DataFrame:
    """Target plus all source rows, duplicates included."""
    return target.unionByName(source)


def duplicate_matches(target: DataFrame, source: DataFrame, unique_key: str | Sequence[str]) -> DataFrame:
    """Keys of the target that several source rows match, with the count."""
    keys = _keys(unique_key)
    counted = _with_key(source, keys).groupBy(*keys).count().where("count > 1")
    have = target.select(*[F.col(f"`{k}`") for k in keys])
    return counted.alias("s").join(have.alias("t"), _on("s", "t", keys), "left_semi")


# -- high-water mark ---------------------------------------------------------------
def high_water_mark(warehouse: Warehouse, name: str, column: str) -> Any:
    """MAX of ``column`` in a stored table (None when it is empty).

    A timestamp comes with its zone (UTC). A table partitioned by that column is asked only for its newest directory.
    """
    manifest = warehouse.manifest(name)
    segments = None
    rule = next((r for r in manifest.layout.rules if r.field.lower() == column.lower()), None)
    if rule is not None and len(manifest.layout.rules) == 1 and _ordered_by_name(rule, manifest):
        values = {s: warehouse.directory_value(s, manifest.directory(rule)) for s in manifest.segments}
        known = [v for v in values.values() if v is not None]
        if known:
            segments = [s for s, v in values.items() if v == max(known)]
    top = F.max(F.col(f"`{column}`"))
    zoned = isinstance(manifest.column(column).data_type, T.TimestampType)
    rows = warehouse.read(name, version=manifest.version, segments=segments, guarded=False)
    found = rows.agg((F.unix_micros(top) if zoned else top).alias("m")).first()["m"]
    if zoned and found is not None:
        return dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(microseconds=found)
    return found


def _ordered_by_name(rule: PartitionRule, manifest: Manifest) -> bool:
    """Whether directory names sort like the values they stand for."""
    if rule.kind == "trunc":
        return True
    return rule.kind == "column" and manifest.column(rule.field).data_type.typeName() == "date"


def newer_than(df: DataFrame, column: str, mark: Any) -> DataFrame:
    """Rows above the mark. It is a literal, so it reaches the file scan.

    As in SQL, a NULL mark (an empty table) lets nothing through; the caller
    decides on a full build instead.
    """
    if mark is None:
        return df.where(F.lit(False))
    return df.where(F.col(f"`{column}`") > literal(mark, df.schema[column].dataType))


# -- table forms -------------------------------------------------------------------
def merge(
    warehouse: Warehouse,
    name: str,
    source: DataFrame,
    unique_key: str | Sequence[str],
    update: bool = True,
    **changes: Any,
) -> Manifest:
    """MERGE ``source`` into a stored table, rewriting only touched files."""
    keys = _keys(unique_key)
    base = warehouse.manifest(name)
    _check_keys(base, source, keys)
    with warehouse.staged(warehouse.fit(base, _must_have_all(base, source))) as rows:
        return _merge_rows(warehouse, base, rows, keys, update, changes)


def _merge_rows(warehouse: Warehouse, base: Manifest, rows: DataFrame, keys: list[str], update: bool, changes) -> Manifest:
    counted = _with_key(rows, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    here = _possible_matches(warehouse, base, rows, keys)
    hits = here.alias("t").join(counted.alias("s"), _on("t", "s", keys), "inner").select("t.*", "s.__n").persist()
    try:
        touched = touched_files(hits, here, F.col("__n"))
        inserts = rows.alias("s").join(hits.alias("t"), _on("s", "t", keys), "left_anti")
        lowered = {k.lower() for k in keys}
        if not update or not touched or {c.name.lower() for c in base.columns} == lowered:
            return warehouse.publish(base, inserts, replaced=(), **changes)
        if any(n > 1 for n in touched.values()):
            raise MergeCardinalityError(
                f"merge into '{base.table}': a stored row is matched by several source rows on ({', '.join(keys)})"
            )
        old = warehouse.read(base.table, version=base.version, segments=list(touched), guarded=False)
        new = rows.withColumn(_MATCH, F.lit(True))
        joined = old.alias("t").join(new.alias("s"), _on("t", "s", keys), "left")
        updated = joined.select(
            *[
                F.col(f"t.`{c}`")
                if c.lower() in lowered
                else F.when(F.col(f"s.{_MATCH}"), F.col(f"s.`{c}`")).otherwise(F.col(f"t.`{c}`")).alias(c)
                for c in old.columns
            ]
        )
        return warehouse.publish(base, updated.unionByName(inserts), replaced=list(touched), **changes)
    finally:
        hits.unpersist()


def insert_only(warehouse: Warehouse, name: str, source: DataFrame, unique_key: str | Sequence[str], **changes: Any) -> Manifest:
    """Insert source rows with new keys; stored rows are not rewritten."""
    return merge(warehouse, name, source, unique_key, update=False, **changes)


def delete_insert(
    warehouse: Warehouse, name: str, source: DataFrame, unique_key: str | Sequence[str], **changes: Any
) -> Manifest:
    """Delete stored rows whose key the source has, then insert all of it."""
    keys = _keys(unique_key)
    base = warehouse.manifest(name)
    _check_keys(base, source, keys)
    with warehouse.staged(warehouse.fit(base, source)) as rows:
        wanted = _with_key(rows, keys).select(*[F.col(f"`{k}`") for k in keys]).distinct()
        here = _possible_matches(warehouse, base, rows, keys)
        touched = touched_files(here.alias("t").join(wanted.alias("s"), _on("t", "s", keys), "left_semi"), here)
        if not touched:
            return warehouse.publish(base, rows, replaced=(), **changes)
        old = warehouse.read(name, version=base.version, segments=list(touched), guarded=False)
        kept = old.alias("t").join(wanted.alias("s"), _on("t", "s", keys), "left_anti")
        return warehouse.publish(base, kept.unionByName(rows), replaced=list(touched), **changes)


def append(warehouse: Warehouse, name: str, source: DataFrame, **changes: Any) -> Manifest:
    """Add all source rows as new files."""
    return warehouse.append(name, source, **changes)


def apply_strategy(
    warehouse: Warehouse,
    name: str,
    source: DataFrame,
    strategy: str = "merge",
    unique_key: str | Sequence[str] | None = None,
    **changes: Any,
) -> Manifest:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown incremental strategy '{strategy}'; use {', '.join(STRATEGIES)}")
    if strategy == "append":
        return append(warehouse, name, source, **changes)
    if unique_key is None:
        raise ValueError(f"strategy '{strategy}' needs a unique_key")
    operator = merge if strategy == "merge" else delete_insert
    return operator(warehouse, name, source, unique_key, **changes)


def _possible_matches(warehouse: Warehouse, base: Manifest, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and file numbers of the stored rows that the source could match.

    Directories are chosen by name if a partition column is a key, files by the key
    index if the table has one; the range of the source's keys goes to the file scan, which skips row groups outside it.
    One small aggregate of the source decides both.
    """
    ranged = [k for k in keys if isinstance(base.column(k).data_type, _RANGED)]
    rules = [r for r in base.layout.rules if r.field.lower() in {k.lower() for k in keys} and _named(base, r)]
    segments = list(base.segments)
    if rules and segments:
        # Values outside a range layout have the NULL directory, too.
        names = [F.coalesce(r.value(F.col(f"`{r.field}`")).cast("string"), F.lit(NULL_DIRECTORY)).alias(f"r{i}") for i, r in enumerate(rules)]
        levels = [base.directory(r) for r in rules]
        places = {s: tuple(warehouse.directory_value(s, c) or NULL_DIRECTORY for c in levels) for s in segments}
        # What reaches the driver are directories of the target, however large the source is.
        schema = T.StructType([T.StructField(f"r{i}", T.StringType()) for i in range(len(rules))])
        there = warehouse.spark.createDataFrame(sorted(set(places.values())), schema)
        wanted = {tuple(r) for r in there.join(_with_key(rows, keys).select(*names), schema.names, "left_semi").collect()}
        segments = [s for s in segments if places[s] in wanted]
    if segments and keyindex.serves(base, keys):
        segments = keyindex.holding(warehouse, base, rows, keys, segments)
    here = numbered(warehouse.read(base.table, version=base.version, segments=segments, located=True, guarded=False))
    if ranged:
        zoned = {k for k in ranged if isinstance(base.column(k).data_type, T.TimestampType)}
        value = lambda k: F.unix_micros(F.col(f"`{k}`")) if k in zoned else F.col(f"`{k}`")
        ends = [f(value(k)).alias(f"{i}{f.__name__}") for i, k in enumerate(ranged) for f in (F.min, F.max)]
        bounds = _with_key(rows, keys).agg(*ends).first()
        for i, k in enumerate(ranged):
            kind = base.column(k).data_type
            low, high = (F.timestamp_micros(F.lit(bounds[f"{i}{end}"]).cast("long")) if k in zoned else literal(bounds[f"{i}{end}"], kind) for end in ("min", "max"))
            here = here.where((F.col(f"`{k}`") >= low) & (F.col(f"`{k}`") <= high))
    return here.select(*[F.col(f"`{k}`") for k in keys], F.col(FILE))


def _named(base: Manifest, rule: PartitionRule) -> bool:
    """Whether a directory name is just the text of its value."""
    kind = rule.storage_type(base.column(rule.field).data_type)
    return isinstance(kind, (T.DateType, T.IntegralType)) or kind == T.StringType()


def _check_keys(base: Manifest, source: DataFrame, keys: Sequence[str]) -> None:
    given = {c.lower() for c in source.columns}
    for k in keys:
        base.column(k)
        if k.lower() not in given:
            raise TableError(f"key column '{k}' is not in the source; it has: {', '.join(source.columns)}")


def _must_have_all(base: Manifest, source: DataFrame) -> DataFrame:
    given = {c.lower() for c in source.columns}
    missing = [c.name for c in base.columns if c.name.lower() not in given]
    if missing:
        raise TableError(f"merge into '{base.table}': the source lacks {', '.join(missing)}")
    return source
