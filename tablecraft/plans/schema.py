"""Declared columns: type names, modes, checks and their Spark types."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Accepted type names (any case) and their canonical form.
TYPE_NAMES = {
    "INT64": "INT64", "INT": "INT64", "INTEGER": "INT64", "BIGINT": "INT64",
    "SMALLINT": "INT64", "TINYINT": "INT64", "BYTEINT": "INT64",
    "FLOAT64": "FLOAT64", "FLOAT": "FLOAT64",
    "NUMERIC": "NUMERIC", "DECIMAL": "NUMERIC",
    "BIGNUMERIC": "BIGNUMERIC", "BIGDECIMAL": "BIGNUMERIC",
    "BOOL": "BOOL", "BOOLEAN": "BOOL",
    "STRING": "STRING", "BYTES": "BYTES",
    "DATE": "DATE", "TIME": "TIME", "DATETIME": "DATETIME", "TIMESTAMP": "TIMESTAMP",
    "JSON": "JSON", "GEOGRAPHY": "GEOGRAPHY",
    "STRUCT": "STRUCT", "RECORD": "STRUCT",
}
# Modes, alter actions, rounding modes, reserved name prefixes.
MODES = ("NULLABLE", "REQUIRED", "REPEATED")
ALTERS = ("rename", "insert", "delete")
ROUNDING_MODES = ("ROUND_HALF_AWAY_FROM_ZERO", "ROUND_HALF_EVEN")
RESERVED_PREFIXES = ("_TABLE_", "_FILE_", "_PARTITION", "_ROW_TIMESTAMP", "_COLIDENTIFIER")
NAME_PATTERN = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,299}")

_SPARK_TYPES = {
    "INT64": T.LongType(),
    "FLOAT64": T.DoubleType(),
    "NUMERIC": T.DecimalType(38, 9),
    "BIGNUMERIC": T.DecimalType(38, 18),
    "BOOL": T.BooleanType(),
    "STRING": T.StringType(),
    "BYTES": T.BinaryType(),
    "DATE": T.DateType(),
    "TIME": T.TimeType(),
    "DATETIME": T.TimestampNTZType(),
    "TIMESTAMP": T.TimestampType(),
    "JSON": T.VariantType(),
    "GEOGRAPHY": T.StringType(),
}


class SchemaError(ValueError):
    """Declared columns that are not allowed."""


def canonical_type(name: str) -> str:
    return TYPE_NAMES.get(name.upper(), "UNKNOWN")


@dataclass(frozen=True)
class Field:
    """One declared column, with what should happen to it on evolution."""

    name: str
    type: str
    mode: str = "NULLABLE"
    description: str = ""
    alter: str | None = None
    alter_from: str | None = None
    default: str | None = None
    rounding_mode: str | None = None
    fields: tuple["Field", ...] = field(default=())

    @property
    def canonical(self) -> str:
        return canonical_type(self.type)

    @property
    def repeated(self) -> bool:
        return self.mode.upper() == "REPEATED"

    @property
    def required(self) -> bool:
        return self.mode.upper() == "REQUIRED"

    def spark_type(self) -> T.DataType:
        if self.canonical == "STRUCT":
            element: T.DataType = T.StructType(
                [T.StructField(f.name, f.spark_type(), True) for f in clean(self.fields)]
            )
        elif self.canonical in _SPARK_TYPES:
            element = _SPARK_TYPES[self.canonical]
        else:
            raise SchemaError(f"column '{self.name}' has unknown type '{self.type}'")
        return T.ArrayType(element, containsNull=False) if self.repeated else element


def clean(fields: Iterable[Field]) -> list[Field]:
    """Drop deleted columns and the evolution marks of the others."""
    return [
        replace(f, alter=None, alter_from=None, fields=tuple(clean(f.fields)))
        for f in fields
        if f.alter != "delete"
    ]


def spark_schema(fields: Iterable[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.spark_type(), not f.required) for f in clean(fields)])


def fingerprint_text(fields: Iterable[Field]) -> str:
    """A stable text form of the clean columns, for equality tests."""
    def plain(f: Field) -> dict:
        out = {"name": f.name, "type": f.canonical, "mode": f.mode}
        if f.description:
            out["description"] = f.description
        if f.default is not None:
            out["default"] = f.default
        if f.rounding_mode:
            out["rounding_mode"] = f.rounding_mode
        if f.fields:
            out["fields"] = [plain(n) for n in f.fields]
        return out

    return json.dumps([plain(f) for f in clean(fields)])


def live_type(kind: T.DataType) -> str:
    """The canonical name of a Spark type; arrays report their element."""
    if isinstance(kind, T.ArrayType):
        return live_type(kind.elementType)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INT64"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "FLOAT64"
    if isinstance(kind, T.DecimalType):
        fits = kind.scale <= 9 and kind.precision - kind.scale <= 29
        return "NUMERIC" if fits else "BIGNUMERIC"
    for name, spark_type in _SPARK_TYPES.items():
        if isinstance(kind, type(spark_type)) and name not in ("NUMERIC", "BIGNUMERIC", "GEOGRAPHY"):
            return name
    return "STRUCT" if isinstance(kind, T.StructType) else "UNKNOWN"


def same_type(declared: Field, kind: T.DataType) -> bool:
    found = live_type(kind)
    if declared.repeated != isinstance(kind, T.ArrayType):
        return False
    # Geography is kept as WKT text.
    return found == declared.canonical or (declared.canonical == "GEOGRAPHY" and found == "STRING")


def problems(fields: Sequence[Field], creating: bool = False, existing: Sequence[str] | None = None) -> list[str]:
    """Everything wrong with a declared column list; empty when it is fine."""
    if not fields:
        return ["the schema needs at least one column"]
    found: list[str] = []
    for f in fields:
        found += _field_problems(f, creating)
    seen: set[str] = set()
    for f in fields:
        if f.alter == "delete":
            continue
        if f.name.lower() in seen:
            found.append(f"duplicate column name '{f.name}' (names ignore case)")
        seen.add(f.name.lower())
    if existing is not None:
        have = {n.lower() for n in existing}
        found += [
            f"column '{f.name}' does not exist; mark a new column with alter='insert'"
            for f in fields
            if f.alter is None and f.name.lower() not in have
        ]
    return found


def _field_problems(f: Field, creating: bool) -> list[str]:
    out: list[str] = []
    if not NAME_PATTERN.fullmatch(f.name):
        out.append(f"invalid column name '{f.name}'")
    if f.name.upper().startswith(RESERVED_PREFIXES):
        out.append(f"column name '{f.name}' starts with a reserved prefix")
    if f.canonical == "UNKNOWN":
        out.append(f"column '{f.name}' has invalid type '{f.type}'")
    if f.mode and f.mode.upper() not in MODES:
        out.append(f"column '{f.name}' has invalid mode '{f.mode}'")
    if f.alter is not None and f.alter not in ALTERS:
        out.append(f"column '{f.name}' has invalid alter '{f.alter}'; use rename, insert or delete")
    if f.alter == "insert" and f.required:
        out.append(f"column '{f.name}': a new column cannot be REQUIRED")
    if creating and f.alter in ("rename", "delete"):
        out.append(f"column '{f.name}': alter='{f.alter}' needs an existing table")
    if f.alter == "rename" and not f.alter_from:
        out.append(f"column '{f.name}': alter='rename' needs alter_from")
    if f.alter_from and f.alter != "rename":
        out.append(f"column '{f.name}': alter_from goes only with alter='rename'")
    if f.rounding_mode:
        if f.canonical not in ("NUMERIC", "BIGNUMERIC"):
            out.append(f"column '{f.name}': rounding_mode goes only with NUMERIC or BIGNUMERIC")
        if f.rounding_mode not in ROUNDING_MODES:
            out.append(f"column '{f.name}': rounding_mode must be {' or '.join(ROUNDING_MODES)}")
    if f.canonical == "STRUCT" and not f.fields:
        out.append(f"column '{f.name}': a STRUCT needs at least one nested field")
    for nested in f.fields:
        out += [f"{f.name}.{p}" for p in _field_problems(nested, creating)]
    return out


# -- data against a declared schema ------------------------------------------
def round_numeric(value: Column, rounding_mode: str | None = None, canonical: str = "NUMERIC") -> Column:
    """Round to the scale of NUMERIC/BIGNUMERIC as the column declares it."""
    target = _SPARK_TYPES[canonical]
    if rounding_mode not in (None, *ROUNDING_MODES):
        raise SchemaError(f"unknown rounding mode '{rounding_mode}'")
    rounder = F.bround if rounding_mode == "ROUND_HALF_EVEN" else F.round
    return rounder(value.cast(T.DecimalType(38, 18)), target.scale).cast(target)


def conform(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Shape a frame like a declared schema, at every nesting level.

    Columns come in declared order with declared types; absent columns and
    absent nested fields become NULL (or the declared default).
    """
    given = {f.name.lower(): f for f in df.schema.fields}
    out = []
    for f in clean(fields):
        have = given.get(f.name.lower())
        value = _shaped(F.col(f"`{have.name}`"), have.dataType, f) if have is not None else _absent(f)
        out.append(value.alias(f.name))
    return df.select(*out)


def _absent(f: Field) -> Column:
    value = F.expr(f.default) if f.default is not None else F.lit(None)
    return value.cast(f.spark_type())


def _shaped(value: Column, kind: T.DataType, f: Field) -> Column:
    if f.repeated:
        if not isinstance(kind, T.ArrayType):
            raise SchemaError(f"column '{f.name}' is REPEATED but the data holds {kind.simpleString()}")
        element = replace(f, mode="NULLABLE")
        return F.transform(value, lambda item: _shaped(item, kind.elementType, element))
    if f.canonical == "STRUCT":
        if not isinstance(kind, T.StructType):
            raise SchemaError(f"column '{f.name}' is a STRUCT but the data holds {kind.simpleString()}")
        have = {n.name.lower(): n for n in kind.fields}
        parts = []
        for nested in clean(f.fields):
            inner = have.get(nested.name.lower())
            part = _shaped(value.getField(inner.name), inner.dataType, nested) if inner is not None else _absent(nested)
            parts.append(part.alias(nested.name))
        return F.when(value.isNotNull(), F.struct(*parts))
    if f.canonical in ("NUMERIC", "BIGNUMERIC"):
        return round_numeric(value, f.rounding_mode, f.canonical)
    if f.canonical == "JSON" and isinstance(kind, T.StringType):
        return F.parse_json(value)
    return value.cast(f.spark_type())


def required_violations(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """One row per REQUIRED column: how many rows hold NULL. One pass."""
    required = [f.name for f in clean(fields) if f.required]
    return per_column(df, {n: F.count_if(F.col(f"`{n}`").isNull()) for n in required}, "violations")


def per_column(df: DataFrame, measures: dict[str, Column], value_name: str) -> DataFrame:
    """Aggregate every measure in one scan, then turn columns into rows."""
    if not measures:
        return df.sparkSession.createDataFrame([], f"column_name string, {value_name} bigint")
    names = list(measures)
    one_row = df.agg(*[measures[n].alias(f"m{i}") for i, n in enumerate(names)])
    pairs = F.array(*[
        F.struct(F.lit(n).alias("column_name"), F.col(f"m{i}").cast("bigint").alias(value_name))
        for i, n in enumerate(names)
    ])
    return one_row.select(F.explode(pairs).alias("p")).select("p.*")
