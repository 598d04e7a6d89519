"""Physical layout: partition rules, clustering, pruned scans, retention."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablecraft.operators.curve import position

LOAD_TIME_COLUMN = "run_ts"
TEXT_MARK = "v"
# Operators by which directories can be left out.
PRUNING = ("==", "<", "<=", ">", ">=", "in", "between", "is_null")
MAX_CLUSTER_COLUMNS = 4
GRANULARITIES = ("HOUR", "DAY", "MONTH", "YEAR")
# Collation names as users of the warehouse write them.
COLLATIONS = {"und:ci": "UNICODE_CI", "": "UTF8_BINARY"}


class LayoutError(ValueError):
    """A layout, or a scan of a laid-out table, that is not allowed."""


@dataclass(frozen=True)
class PartitionRule:
    """How one directory level is computed from a row.

    ``kind`` is ``column`` (the column itself), ``text`` (a string, marked so that
    an empty one has a directory of its own), ``trunc`` (date/time cut to a
    granularity), ``range`` (integer buckets) or ``is_null`` (open/closed).
    """

    kind: str
    field: str
    column: str
    granularity: str = "DAY"
    start: int = 0
    end: int = 0
    interval: int = 1

    @property
    def hidden(self) -> bool:
        return self.kind != "column"

    def value(self, source: Column) -> Column:
        """The directory value of a row, from its ``field``."""
        if self.kind == "column":
            return source
        if self.kind == "is_null":
            return source.isNull()
        if self.kind == "text":
            return F.concat(F.lit(TEXT_MARK), source)
        if self.kind == "range":
            bucket = F.floor((source - self.start) / F.lit(self.interval)) * self.interval + self.start
            return F.when((source >= self.start) & (source < self.end), bucket.cast("bigint"))
        if self.granularity == "HOUR":
            return F.date_format(source, "yyyy-MM-dd-HH")
        return F.trunc(source, self.granularity) if self.granularity != "DAY" else source.cast("date")

    def storage_type(self, source: T.DataType) -> T.DataType:
        if self.kind == "column":
            return source
        if self.kind == "is_null":
            return T.BooleanType()
        if self.kind == "range":
            return T.LongType()
        if self.kind == "text":
            return T.StringType()
        return T.StringType() if self.granularity == "HOUR" else T.DateType()

    def implied(self, op: str, value: Any, kind: T.DataType) -> Column | None:
        """What a predicate on ``field`` (of type ``kind``) implies for the directory."""
        if self.kind == "column":
            return None
        stored = F.col(self.column)
        if self.kind == "is_null":
            return {"is_null": stored, "not_null": ~stored}.get(op)
        if op == "is_null":
            return stored.isNull()
        if op == "in":
            # Inclusive bounds of the list prune safely whatever its size.
            values = [v for v in value if v is not None]
            return self.implied("between", (min(values), max(values)), kind) if values else None
        if op == "between":
            return self.implied(">=", value[0], kind) & self.implied("<=", value[1], kind)
        if op not in ("==", "<", "<=", ">", ">="):
            return None
        if self.kind == "range":
            return self._implied_range(op, int(value), stored)
        cut = self.value(literal(value, kind))
        if op == "==":
            return stored == cut
        return stored <= cut if op in ("<", "<=") else stored >= cut

    def may_hold(self, directory: str | None, op: str, value: Any) -> bool:
        """Whether a directory can hold rows that pass ``(field, op, value)``.

        Decided from the directory's name alone; True when in doubt.
        """
        if self.kind == "is_null":
            return {"is_null": directory == "true", "not_null": directory != "true"}.get(op, True)
        if op == "is_null":
            return directory is None
        if op == "between":
            return self.may_hold(directory, ">=", value[0]) and self.may_hold(directory, "<=", value[1])
        if op == "in":
            return any(self.may_hold(directory, "==", v) for v in value if v is not None)
        if op not in ("==", "<", "<=", ">", ">="):
            return True
        name, wanted = directory, self._directory_name(value)
        if wanted is None:
            return True
        if self.kind == "range":
            if directory is None:
                return True
            name, wanted = int(directory), (int(value) - self.start) // self.interval * self.interval + self.start
        elif directory is None:
            return False
        return {"==": name == wanted, "<": name <= wanted, "<=": name <= wanted}.get(op, name >= wanted)

    def _directory_name(self, value: Any) -> str | None:
        """The name of the directory a value belongs to; its order is that of values."""
        if self.kind == "range":
            return str(value)
        if self.kind == "text":
            return f"{TEXT_MARK}{value}" if isinstance(value, str) else None
        if not isinstance(value, (dt.date, dt.datetime)):
            return None
        if isinstance(value, dt.datetime) and (value.tzinfo is not None or self.kind == "column"):
            return None
        if self.kind == "column" or self.granularity == "DAY":
            return value.strftime("%Y-%m-%d")
        if self.granularity == "HOUR":
            return value.strftime("%Y-%m-%d-%H")
        return value.strftime("%Y-%m-01" if self.granularity == "MONTH" else "%Y-01-01")

    def _implied_range(self, op: str, value: int, stored: Column) -> Column:
        # Rows outside [start, end) and NULLs share the overflow (NULL) directory.
        inside = self.start <= value < self.end
        bucket = (value - self.start) // self.interval * self.interval + self.start
        if op == "==":
            return (stored == bucket) if inside else stored.isNull()
        if op in ("<", "<="):
            return (stored <= bucket) | stored.isNull()
        return (stored >= bucket) | stored.isNull()


@dataclass(frozen=True)
class Layout:
    """Partition rules, cluster columns and table-level storage options."""

    rules: tuple[PartitionRule, ...] = ()
    cluster_by: tuple[str, ...] = ()
    require_filter: bool = False
    partition_expiration_days: float | None = None
    #: Whole writes follow a curve through all cluster columns instead of sorting by the first.
    curve: bool = False

    def __post_init__(self):
        if self.curve and len(self.cluster_by) < 2:
            raise LayoutError("a curve needs two or more cluster_by columns")
        if len(self.cluster_by) > MAX_CLUSTER_COLUMNS:
            raise LayoutError(
                f"cluster_by has {len(self.cluster_by)} columns, at most {MAX_CLUSTER_COLUMNS} are allowed"
            )
        if self.require_filter and not self.rules:
            raise LayoutError("require_partition_filter needs partition_by")
        if self.partition_expiration_days is not None and not self.rules:
            raise LayoutError("partition_expiration_days needs partition_by")

    # -- declaration -----------------------------------------------------
    @classmethod
    def of(
        cls,
        partition_by: dict | PartitionRule | None = None,
        cluster_by: Sequence[str] | str | None = None,
        require_partition_filter: bool = False,
        partition_expiration_days: float | None = None,
        curve: bool = False,
    ) -> "Layout":
        """Build a layout from the options a model declares.

        ``partition_by={'field': 'created_at', 'data_type': 'timestamp',
        'granularity': 'month'}``; without ``field`` rows are partitioned by
        load time (column ``run_ts``).
        """
        rules: tuple[PartitionRule, ...] = ()
        if isinstance(partition_by, PartitionRule):
            rules = (partition_by,)
        elif partition_by is not None:
            rules = (_rule_from_options(partition_by),)
        cluster = (cluster_by,) if isinstance(cluster_by, str) else tuple(cluster_by or ())
        return cls(rules, cluster, require_partition_filter, partition_expiration_days, curve)

    def renamed(self, mapping: dict[str, str]) -> "Layout":
        """The same layout after columns were renamed (keys in lower case)."""
        def new(name: str) -> str:
            return mapping.get(name.lower(), name)

        return replace(
            self,
            rules=tuple(replace(r, field=new(r.field)) for r in self.rules),
            cluster_by=tuple(new(c) for c in self.cluster_by),
        )

    def for_types(self, types: Mapping[str, T.DataType]) -> "Layout":
        """String columns are partitioned by a marked copy: Spark's directories cannot tell '' from NULL."""
        def rule(r: PartitionRule) -> PartitionRule:
            text = r.kind == "column" and isinstance(types.get(r.field.lower()), T.StringType)
            return replace(r, kind="text", column=f"_p_{r.field}") if text else r

        return replace(self, rules=tuple(map(rule, self.rules)))

    def fields(self) -> list[str]:
        return [r.field for r in self.rules] + list(self.cluster_by)

    # -- writing -----------------------------------------------------------
    @staticmethod
    def arrange(
        df: DataFrame, directories: Sequence[str], cluster_columns: Sequence[str], whole: bool = True, curve: bool = False
    ) -> DataFrame:
        """Distribute rows for the write.

        ``REBALANCE`` on the partition columns lets AQE join small directories
        into one file and split a hot one over many tasks. A clustered table
        that is written whole is range-partitioned on partition and cluster
        columns plus a row hash, so that one hot value is spread as well. Range
        bounds need a sampling pass over the input, so increments, which come
        out of joins, are only sorted within their files.
        """
        order = [F.col(f"`{c}`") for c in (*directories, *cluster_columns)]
        if not cluster_columns:
            return df.hint("rebalance", *directories) if directories else df
        if not whole:
            return df.hint("rebalance", *directories).sortWithinPartitions(*order)
        spread = F.xxhash64(*[
            F.col(f"`{f.name}`")
            for f in df.schema.fields
            if isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))
            or f.dataType == T.StringType()
        ] or [F.lit(0)])
        place = position(df, cluster_columns) if curve else None
        if place is not None:
            # Ranges end at the directories and the place; inside a file the place comes first, too. As a
            # column it is computed once, not in every comparison.
            ends = [*order[:len(directories)], F.col("__place")]
            placed = df.withColumn("__place", place).repartitionByRange(*ends, spread)
            return placed.sortWithinPartitions(*ends, *order[len(directories):]).drop("__place")
        return df.repartitionByRange(*order, spread).sortWithinPartitions(*order)

    # -- (de)serialisation -------------------------------------------------
    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, raw: dict) -> "Layout":
        return cls(
            rules=tuple(PartitionRule(**r) for r in raw["rules"]),
            cluster_by=tuple(raw["cluster_by"]),
            require_filter=raw["require_filter"],
            partition_expiration_days=raw["partition_expiration_days"],
            curve=raw.get("curve", False),
        )


def date_partition(field: str) -> PartitionRule:
    """Partition by a DATE (or any plain) column itself."""
    return PartitionRule("column", field, field)


def time_partition(field: str | None = None, granularity: str = "DAY") -> PartitionRule:
    """Partition by a timestamp cut to ``granularity``; load time if no field."""
    name = field or LOAD_TIME_COLUMN
    unit = granularity.upper()
    if unit not in GRANULARITIES:
        raise LayoutError(f"granularity '{granularity}' is not one of {', '.join(GRANULARITIES)}")
    return PartitionRule("trunc", name, f"_p_{name}", granularity=unit)


def range_partition(field: str, start: int, end: int, interval: int) -> PartitionRule:
    """Integer buckets of ``interval`` from ``start`` up to, not including, ``end``."""
    if interval <= 0 or end <= start:
        raise LayoutError("range partition needs interval > 0 and end > start")
    return PartitionRule("range", field, f"_p_{field}", start=start, end=end, interval=interval)


def _rule_from_options(options: dict) -> PartitionRule:
    field_name = options.get("field")
    if "field" in options and not field_name:
        raise LayoutError("partition_by must name a field, e.g. {'field': 'created_at', 'data_type': 'date'}")
    kind = str(options.get("data_type", "date" if field_name else "timestamp")).lower()
    if "range" in options:
        bounds = options["range"]
        return range_partition(field_name, bounds["start"], bounds["end"], bounds["interval"])
    if kind in ("timestamp", "datetime"):
        return time_partition(field_name, options.get("granularity") or "DAY")
    return date_partition(field_name)


# -- filters -----------------------------------------------------------------
Filter = tuple[str, str, Any]


def literal(value: Any, kind: T.DataType | None = None) -> Column:
    """A literal of the column's type, whatever the zone of the Python process.

    A time without zone is meant in the session's zone.
    """
    if not isinstance(value, (dt.datetime, dt.date)) or kind is None:
        return F.lit(value)
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        since = value - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
        return F.timestamp_micros(F.lit(since // dt.timedelta(microseconds=1))).cast(kind)
    return F.lit(value.isoformat()).cast(kind)


def condition(name: str, op: str, value: Any, kind: T.DataType | None = None) -> Column:
    """One ``(column, operator, value)`` filter as a Spark condition."""
    c = F.col(f"`{name}`")
    simple = {
        "==": c.__eq__, "!=": c.__ne__, "<": c.__lt__, "<=": c.__le__, ">": c.__gt__, ">=": c.__ge__,
    }
    if op in simple:
        return simple[op](literal(value, kind))
    if op == "in":
        return c.isin([literal(v, kind) for v in value])
    if op == "between":
        return c.between(literal(value[0], kind), literal(value[1], kind))
    if op == "is_null":
        return c.isNull()
    if op == "not_null":
        return c.isNotNull()
    raise LayoutError(f"unknown filter operator '{op}'")


def scan(warehouse, name: str, where: Iterable[Filter] = ()) -> DataFrame:
    """Read a stored table with the given conjunctive filters.

    Filters on the partition field choose the directories before Spark lists
    any file, and become filters on the directory column as well. A table that
    requires a partition filter refuses a scan without one.
    """
    filters = [(n, op, v) for n, op, v in where]
    manifest = warehouse.manifest(name)
    fields = {r.field.lower() for r in manifest.layout.rules}
    if manifest.layout.require_filter and not any(n.lower() in fields and op in PRUNING for n, op, _ in filters):
        raise LayoutError(
            f"table '{name}' requires a filter on its partition column ({', '.join(sorted(fields))})"
        )
    by_field = [
        (r, op, v)
        for n, op, v in filters
        for r in manifest.layout.rules
        if r.field.lower() == n.lower() and warehouse.same_zone(manifest)
    ]
    wanted = []
    for segment in manifest.segments:
        holds = (
            rule.may_hold(warehouse.directory_value(segment, manifest.directory(rule)), op, v)
            for rule, op, v in by_field
        )
        if all(holds):
            wanted.append(segment)
    df = warehouse.read(name, version=manifest.version, segments=wanted, directories=True, guarded=False)
    for column, op, value in filters:
        df = df.where(condition(column, op, value, manifest.column(column).data_type))
    for rule, op, value in by_field:
        implied = rule.implied(op, value, manifest.column(rule.field).data_type)
        if implied is not None:
            df = df.where(implied)
    return df.select(*[F.col(f"`{c.name}`") for c in manifest.columns])


# -- retention ---------------------------------------------------------------
def expire_partitions(warehouse, name: str, now: dt.datetime, days: float | None = None, ms: int | None = None) -> int:
    """Drop partitions older than ``days`` (or ``ms``) before ``now``.

    A partition goes when the *end* of its period is older than the cut-off,
    as no row in it can be younger. Only the manifest changes; returns the
    number of directories dropped. Unpartitioned tables are refused: use
    :func:`expire_table`.
    """
    manifest = warehouse.manifest(name)
    rule = next((r for r in manifest.layout.rules if r.kind in ("trunc", "column")), None)
    if rule is None:
        raise LayoutError(f"table '{name}' has no time partitioning")
    if days is None and ms is None:
        days = manifest.layout.partition_expiration_days
    if days is None and ms is None:
        raise LayoutError("give days or ms, or declare partition_expiration_days")
    cutoff = now - (dt.timedelta(days=days) if days is not None else dt.timedelta(milliseconds=ms))
    keep = []
    for segment in manifest.segments:
        value = warehouse.directory_value(segment, manifest.directory(rule))
        if value is None or _period_end(value, rule) > cutoff:
            keep.append(segment)
    if len(keep) < len(manifest.segments):
        warehouse.commit(manifest, segments=keep)
    return len(manifest.segments) - len(keep)


def _period_end(value: str, rule: PartitionRule) -> dt.datetime:
    if rule.kind == "trunc" and rule.granularity == "HOUR":
        return dt.datetime.strptime(value, "%Y-%m-%d-%H") + dt.timedelta(hours=1)
    start = dt.datetime.fromisoformat(value[:10])
    if rule.kind == "trunc" and rule.granularity == "MONTH":
        return dt.datetime(start.year + start.month // 12, start.month % 12 + 1, 1)
    if rule.kind == "trunc" and rule.granularity == "YEAR":
        return dt.datetime(start.year + 1, 1, 1)
    return start + dt.timedelta(days=1)


def expire_table(warehouse, name: str, now: dt.datetime) -> bool:
    """Drop a whole table whose ``expires_at`` (or dataset default) has passed."""
    if not warehouse.exists(name):
        return False
    expires = warehouse.manifest(name).properties.get("expires_at")
    if expires is None or dt.datetime.fromisoformat(expires) > now:
        return False
    warehouse.drop(name)
    return True


# -- collation ---------------------------------------------------------------
def collate(df: DataFrame, collation: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Give string columns a default collation (``und:ci`` ignores case)."""
    name = COLLATIONS.get(collation, collation)
    wanted = {c.lower() for c in columns} if columns is not None else None
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType) and (wanted is None or f.name.lower() in wanted):
            c = F.collate(c, name).alias(f.name)
        out.append(c)
    return df.select(*out)
