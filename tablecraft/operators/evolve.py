"""Column evolution: drop, rename, add, describe, as one change of metadata.

Files keep the column names they were written with; the manifest maps them to
the current names. So no evolution rewrites data, swaps and cycles of renames
are a single simultaneous mapping, and a re-added name never shows old values.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from tablecraft.plans import schema as sc
from tablecraft.plans.schema import Field, SchemaError
from tablecraft.sources.warehouse import Manifest, StoredColumn, Warehouse

_APPLIED = "evolved_to"


@dataclass(frozen=True)
class Consumers:
    """Columns that downstream models and snapshots rely on."""

    unique_keys: Sequence[str] = ()
    partition_fields: Sequence[str] = ()
    cluster_columns: Sequence[str] = ()


@dataclass(frozen=True)
class Change:
    """What an annotated column list means for the current columns."""

    drops: tuple[str, ...]
    renames: dict[str, str]
    adds: tuple[Field, ...]
    descriptions: dict[str, str]

    def __bool__(self) -> bool:
        return bool(self.drops or self.renames or self.adds or self.descriptions)


def plan_change(current: Sequence[str], comments: dict[str, str], fields: Sequence[Field]) -> Change:
    """Compare annotated columns with the current ones.

    Every action is idempotent: dropping an absent column, renaming from an
    absent one and adding a present one do nothing.
    """
    have = {c.lower() for c in current}
    drops = tuple(f.name.lower() for f in fields if f.alter == "delete" and f.name.lower() in have)
    renames = {
        f.alter_from.lower(): f.name
        for f in fields
        if f.alter == "rename" and f.alter_from and f.alter_from.lower() in have
    }
    # A name freed by a drop or rename in the same change can be added again.
    left = {renames.get(c, c).lower() for c in have - set(drops)}
    adds = tuple(f for f in fields if f.alter == "insert" and f.name.lower() not in left)
    descriptions = {
        f.name.lower(): f.description
        for f in fields
        if f.alter is None and f.name.lower() in have and comments.get(f.name.lower(), "") != f.description
    }
    after = [renames.get(c.lower(), c).lower() for c in current if c.lower() not in drops]
    after += [f.name.lower() for f in adds]
    twice = sorted({n for n in after if after.count(n) > 1})
    if twice:
        raise SchemaError(f"the change would give two columns of the same name: {', '.join(twice)}")
    return Change(drops, renames, adds, descriptions)


def drop_problems(drops: Sequence[str], consumers: Consumers) -> list[str]:
    """Why columns may not be dropped; names ignore case."""
    uses = (
        ("a key that models or histories match rows by", consumers.unique_keys),
        ("what a table is partitioned by", consumers.partition_fields),
        ("among the columns a table is clustered by", consumers.cluster_columns),
    )
    return [
        f"column '{d}' has to stay: it is {what}"
        for d in drops
        for what, names in uses
        if d.lower() in {n.lower() for n in names}
    ]


def evolve(
    warehouse: Warehouse, name: str, fields: Sequence[Field], consumers: Consumers = Consumers()
) -> Manifest:
    """Apply an annotated column list to a stored table.

    Drops, renames, additions and descriptions become one new version. All
    checks come first, so a refused change leaves the table as it was.
    Applying the same list again does nothing.
    """
    base = warehouse.manifest(name)
    marker = json.dumps([sc.fingerprint_text(fields), [(f.name, f.alter, f.alter_from) for f in fields]])
    if base.properties.get(_APPLIED) == marker:
        return base
    found = sc.problems(fields, existing=[c.name for c in base.columns])
    if found:
        raise SchemaError("; ".join(found))
    change = plan_change([c.name for c in base.columns], {c.name.lower(): c.comment for c in base.columns}, fields)
    own = Consumers(
        partition_fields=[*consumers.partition_fields, *[r.field for r in base.layout.rules]],
        cluster_columns=[*consumers.cluster_columns, *base.layout.cluster_by],
        unique_keys=consumers.unique_keys,
    )
    found = drop_problems(change.drops, own)
    if found:
        raise SchemaError("; ".join(found))
    columns: list[StoredColumn] = []
    for c in base.columns:
        if c.name.lower() in change.drops:
            continue
        comment = change.descriptions.get(c.name.lower(), c.comment)
        columns.append(replace(c, name=change.renames.get(c.name.lower(), c.name), comment=comment))
    used = list(base.used_names)
    for f in change.adds:
        stored_as = f.name if f.name.lower() not in used else f"{f.name}_{base.version + 1}"
        used.append(stored_as.lower())
        columns.append(_added(warehouse, f, stored_as))
    return warehouse.commit(
        base,
        columns=tuple(columns),
        used_names=tuple(used),
        layout=base.layout.renamed(change.renames),
        properties={**base.properties, _APPLIED: marker},
    )


def _added(warehouse: Warehouse, f: Field, stored_as: str) -> StoredColumn:
    existing = None
    if f.default is not None:
        # Evaluated once, so that rows stored before the change agree on it.
        kind = f.spark_type().simpleString()
        text = warehouse.spark.range(1).select(F.expr(f"CAST(CAST({f.default} AS {kind}) AS STRING)").alias("v")).first()["v"]
        if text is not None:
            quoted = text.replace("\\", "\\\\").replace("'", "\\'")
            existing = f"CAST('{quoted}' AS {kind})"
    return StoredColumn(
        name=f.name,
        stored_as=stored_as,
        type=json.dumps(f.spark_type().jsonValue()),
        comment=f.description,
        default=f.default,
        existing_value=existing,
        rounding=f.rounding_mode,
    )


def evolve_frame(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """The same change as one projection over a frame."""
    comments = {f.name.lower(): (f.metadata or {}).get("comment", "") for f in df.schema.fields}
    found = sc.problems(fields, existing=df.columns)
    if found:
        raise SchemaError("; ".join(found))
    change = plan_change(df.columns, comments, fields)
    out = []
    for c in df.columns:
        if c.lower() in change.drops:
            continue
        comment = change.descriptions.get(c.lower(), comments[c.lower()])
        out.append(
            F.col(f"`{c}`").alias(change.renames.get(c.lower(), c), metadata={"comment": comment} if comment else {})
        )
    for f in change.adds:
        value = F.expr(f.default) if f.default is not None else F.lit(None)
        out.append(value.cast(f.spark_type()).alias(f.name, metadata={"comment": f.description} if f.description else {}))
    return df.select(*out)


def columns_from_fields(fields: Sequence[Field]) -> list[StoredColumn]:
    """Declared columns for creating a table (types, modes, comments, rounding)."""
    found = sc.problems(fields, creating=True)
    if found:
        raise SchemaError("; ".join(found))
    return [
        StoredColumn(
            name=f.name,
            stored_as=f.name,
            type=json.dumps(f.spark_type().jsonValue()),
            required=f.required,
            comment=f.description,
            default=f.default,
            rounding=f.rounding_mode,
        )
        for f in sc.clean(fields)
    ]
