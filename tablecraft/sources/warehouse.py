"""Versioned parquet tables: a folder per table and one small manifest per version.

Spark's built-in parquet tables take no MERGE, UPDATE or DELETE and cannot be
overwritten while they are read. So every change writes new directories and
then publishes a new manifest naming the live ones; readers of the old version
are undisturbed and a failed write leaves only unreferenced directories.

    <root>/<table>/_manifests/00000000000000000007.json
    <root>/<table>/__version=7-1f3a9c2e/_p_ts=2024-01-01/part-....parquet
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablecraft.operators.layout import COLLATIONS, LOAD_TIME_COLUMN, Layout, LayoutError, PartitionRule, literal
from tablecraft.sources.files import Files, fresh_folder

FILE = "__file"
VERSION = "__version"
# Staged frames are kept at least so long; a job that stages one is over by then.
STAGED_FOR = dt.timedelta(days=2)
NULL_DIRECTORY = "__HIVE_DEFAULT_PARTITION__"


class TableError(ValueError):
    """A table that does not exist, or a frame that does not fit it."""


class ConcurrentWriteError(RuntimeError):
    """Another writer published the same version first."""


@dataclass(frozen=True)
class StoredColumn:
    """A column as readers see it and the name it has inside the files."""

    name: str
    stored_as: str
    type: str
    required: bool = False
    comment: str = ""
    default: str | None = None
    existing_value: str | None = None
    rounding: str | None = None

    @property
    def data_type(self) -> T.DataType:
        return _parse_type(self.type)


@dataclass(frozen=True)
class Manifest:
    table: str
    version: int
    columns: tuple[StoredColumn, ...]
    layout: Layout
    segments: tuple[str, ...] = ()
    written: Mapping[str, int] = field(default_factory=dict)
    used_names: tuple[str, ...] = ()
    properties: Mapping[str, Any] = field(default_factory=dict)
    batches: Mapping[str, int] = field(default_factory=dict)

    def column(self, name: str) -> StoredColumn:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise TableError(
            f"table '{self.table}' has no column '{name}'; it has: {', '.join(c.name for c in self.columns)}"
        )

    def directory(self, rule: PartitionRule) -> str:
        """The directory level a partition rule writes to."""
        return rule.column if rule.hidden else self.column(rule.field).stored_as

    def to_text(self) -> str:
        raw = asdict(replace(self, layout=None))
        raw["layout"] = self.layout.to_json()
        return json.dumps(raw)

    @classmethod
    def from_text(cls, text: str) -> "Manifest":
        raw = json.loads(text)
        return cls(
            table=raw["table"],
            version=raw["version"],
            columns=tuple(StoredColumn(**c) for c in raw["columns"]),
            layout=Layout.from_json(raw["layout"]),
            segments=tuple(raw["segments"]),
            written=raw["written"],
            used_names=tuple(raw["used_names"]),
            properties=raw["properties"],
            batches=raw["batches"],
        )


class Warehouse:
    """Create, read and change the tables below one root folder.

    New tables take the default expirations unless they say otherwise.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str | None = None,
        default_table_expiration: dt.timedelta | None = None,
        default_partition_expiration_days: float | None = None,
    ):
        self.spark = spark
        self.root = (root or fresh_folder(spark, "tables")).rstrip("/")
        self.files = Files(spark)
        self.default_table_expiration = default_table_expiration
        self.default_partition_expiration_days = default_partition_expiration_days

    # -- metadata ------------------------------------------------------------
    def _folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _manifest_names(self, name: str) -> list[str]:
        found = self.files.child_files(f"{self._folder(name)}/_manifests")
        return [f for f in found if f.endswith(".json") and not f.startswith(".")]

    def exists(self, name: str) -> bool:
        names = self._manifest_names(name)
        return bool(names) and bool(self._load(name, names[-1]).columns)

    def _load(self, name: str, leaf: str) -> Manifest:
        return Manifest.from_text(self.files.read_text(f"{self._folder(name)}/_manifests/{leaf}"))

    def manifest(self, name: str, version: int | None = None) -> Manifest:
        names = self._manifest_names(name)
        leaf = names[-1] if names and version is None else f"{version or 0:020d}.json"
        if leaf not in names:
            raise TableError(f"table '{name}' does not exist" + (f" at version {version}" if version else ""))
        found = self._load(name, leaf)
        if not found.columns:
            raise TableError(f"table '{name}' does not exist (dropped)")
        return found

    def tables(self) -> list[str]:
        if not self.files.exists(self.root):
            return []
        return [t for t in self.files.child_dirs(self.root) if not t.startswith("_") and self.exists(t)]

    def commit(self, base: Manifest, **changes: Any) -> Manifest:
        """Publish ``base`` plus ``changes`` as the next version.

        ``batches`` are added to those of ``base``, so a stream never forgets another one's.
        """
        if "batches" in changes:
            changes["batches"] = {**base.batches, **changes["batches"]}
        if "segments" in changes:
            changes["segments"] = tuple(changes["segments"])
        new = replace(base, version=base.version + 1, **changes)
        path = f"{self._folder(base.table)}/_manifests/{new.version:020d}.json"
        if not self.files.write_new(path, new.to_text()):
            raise ConcurrentWriteError(
                f"table '{base.table}': version {new.version} was written by someone else; run again"
            )
        return new

    def drop(self, name: str) -> None:
        """Forget a table; its files go with :meth:`vacuum`."""
        self.commit(self.manifest(name), columns=(), segments=(), written={}, properties={}, batches={})

    def vacuum(self, name: str, older_than: dt.timedelta = dt.timedelta(days=7)) -> int:
        """Delete what the latest version does not use, if it has not changed for ``older_than``.

        Folders of versions that are not published yet belong to running writers and
        stay. Readers of an old version are safe for ``older_than``.
        """
        limit = time.time() - older_than.total_seconds()
        names = self._manifest_names(name)
        latest = self._load(name, names[-1])
        live = {s.split("/", 1)[0] for s in latest.segments}
        table = self._folder(name)
        stale = [
            f"{table}/{d}" for d in self.files.child_dirs(table)
            if d.startswith(f"{VERSION}=") and d not in live and int(d.partition("=")[2].partition("-")[0]) <= latest.version
        ]
        staged = f"{self.root}/_staged"
        if self.files.exists(staged):
            # A staged frame is in use as long as its job runs: it needs an age whatever the caller says.
            old = time.time() - max(older_than, STAGED_FOR).total_seconds()
            for d in self.files.child_dirs(staged):
                if self.files.modified(f"{staged}/{d}") < old:
                    self.files.delete(f"{staged}/{d}")
        for leaf in names[:-1]:
            if self.files.modified(f"{table}/_manifests/{leaf}") <= limit:
                self.files.delete(f"{table}/_manifests/{leaf}")
        gone = [d for d in stale if self.files.modified(d) <= limit]
        for d in gone:
            self.files.delete(d)
        return len(gone)

    def compact(self, name: str) -> Manifest:
        """Rewrite partitions that are spread over several versions or split into files.

        Appends and merges add directories; this puts each partition into one again.
        """
        base = self.manifest(name)
        by_place: dict[str, list[str]] = {}
        for s in base.segments:
            place = s.partition("/")[2]
            by_place.setdefault(place.rpartition("/")[0] if _is_file(s) else place, []).append(s)
        spread = [s for members in by_place.values() if len(members) > 1 for s in members]
        if not spread:
            return base
        rows = self.read(name, version=base.version, segments=spread, guarded=False)
        return self.publish(base, rows, replaced=spread)

    @staticmethod
    def directory_value(segment: str, column: str) -> str | None:
        for part in segment.split("/"):
            key, _, value = part.partition("=")
            if key == column:
                return None if value == NULL_DIRECTORY else unquote(value)
        return None

    # -- reading -------------------------------------------------------------
    def read(
        self,
        name: str,
        version: int | None = None,
        segments: Sequence[str] | None = None,
        directories: bool = False,
        located: bool = False,
        guarded: bool = True,
    ) -> DataFrame:
        """The table as a lazy DataFrame.

        ``segments`` limits the read to some directories, ``directories`` adds
        the hidden partition columns, ``located`` adds the file each row came
        from. Tables that require a partition filter are read with
        :func:`tablecraft.operators.layout.scan` (``guarded=False`` skips that).
        """
        manifest = self.manifest(name, version)
        if guarded and manifest.layout.require_filter:
            raise LayoutError(f"table '{name}' requires a partition filter; use scan(warehouse, '{name}', where=...)")
        hidden = [r for r in manifest.layout.rules if r.hidden]
        chosen = list(manifest.segments if segments is None else segments)
        wanted: list[Column] = []
        for c in manifest.columns:
            wanted.append(F.col(f"`{c.stored_as}`").alias(c.name, metadata={"comment": c.comment} if c.comment else {}))
        if directories:
            wanted += [F.col(r.column) for r in hidden]
        schema = self._file_schema(manifest)
        if not chosen:
            df = self.spark.createDataFrame([], schema).select(*wanted)
            return df.withColumn(FILE, F.lit(None).cast("string")) if located else df
        base = self._folder(name)
        df = (
            self.spark.read.schema(schema)
            .option("basePath", base)
            .parquet(*[f"{base}/{s}" for s in self._shortest_paths(manifest, chosen)])
        )
        if located:
            wanted.append(F.col("_metadata.file_path").alias(FILE))
        return df.select(*wanted)

    @staticmethod
    def _shortest_paths(manifest: Manifest, chosen: Sequence[str]) -> list[str]:
        """Name a version folder once when all its directories are wanted."""
        by_version: dict[str, list[str]] = {}
        for s in chosen:
            by_version.setdefault(s.split("/", 1)[0], []).append(s)
        paths: list[str] = []
        for folder, members in by_version.items():
            whole = len(members) == manifest.written.get(folder) and not any(map(_is_file, members))
            paths += [folder] if whole else members
        return paths

    def _file_schema(self, manifest: Manifest) -> T.StructType:
        fields = []
        for c in manifest.columns:
            meta = {"EXISTS_DEFAULT": c.existing_value, "CURRENT_DEFAULT": c.existing_value} if c.existing_value else {}
            fields.append(T.StructField(c.stored_as, c.data_type, True, meta))
        for r in manifest.layout.rules:
            if r.hidden:
                fields.append(T.StructField(r.column, r.storage_type(manifest.column(r.field).data_type)))
        return T.StructType(fields)

    # -- writing -------------------------------------------------------------
    def create(
        self,
        name: str,
        df: DataFrame,
        layout: Layout | None = None,
        properties: Mapping[str, Any] | None = None,
        columns: Sequence[StoredColumn] | None = None,
        run_ts=None,
        batches: Mapping[str, int] | None = None,
    ) -> Manifest:
        """Create or replace a table with the rows of ``df``."""
        layout = layout or Layout()
        if any(r.field == LOAD_TIME_COLUMN for r in layout.rules) and LOAD_TIME_COLUMN not in df.columns:
            df = df.withColumn(
                LOAD_TIME_COLUMN, literal(run_ts, T.TimestampType()) if run_ts is not None else F.current_timestamp()
            )
        properties = dict(properties or {})
        if self.default_table_expiration is not None and "expires_at" not in properties:
            created = (run_ts or dt.datetime.now(dt.UTC)).replace(tzinfo=None)
            properties["expires_at"] = (created + self.default_table_expiration).isoformat()
        if layout.rules and layout.partition_expiration_days is None:
            layout = replace(layout, partition_expiration_days=self.default_partition_expiration_days)
        described = tuple(columns or columns_of(df.schema))
        layout = layout.for_types({c.name.lower(): c.data_type for c in described})
        if properties.get("default_collation"):
            described = tuple(_collated(c, properties["default_collation"]) for c in described)
        names = self._manifest_names(name)
        previous = self._load(name, names[-1]).version if names else 0
        base = Manifest(
            table=name,
            version=previous,
            columns=described,
            layout=layout,
            used_names=tuple(c.stored_as.lower() for c in described),
            properties=properties,
            batches=dict(batches or {}),
        )
        for needed in layout.fields():
            base.column(needed)
        if self._zoned(base):
            base = replace(base, properties={**base.properties, "time_zone": self._zone()})
        taken = {VERSION, FILE, *[r.column.lower() for r in layout.rules if r.hidden]}
        clash = [c.name for c in described if c.name.lower() in taken]
        if clash:
            raise TableError(f"column names kept for directories: {', '.join(clash)}")
        added = self.write_segments(base, df)
        return self.commit(base, segments=added, written=self._counted(base, added, kept=()))

    def overwrite(self, name: str, df: DataFrame, **changes: Any) -> Manifest:
        """Replace all rows; columns, layout and properties stay."""
        base = self.manifest(name)
        return self.publish(base, df, replaced=base.segments, whole=True, **changes)

    def append(self, name: str, df: DataFrame, **changes: Any) -> Manifest:
        """Add rows; nothing already stored is read or rewritten."""
        return self.publish(self.manifest(name), df, replaced=(), **changes)

    def publish(
        self, base: Manifest, df: DataFrame, replaced: Sequence[str], whole: bool = False, **changes: Any
    ) -> Manifest:
        """Write ``df`` and swap it in for the ``replaced`` directories and files.

        ``whole`` says that these are all rows of the table. A directory that loses
        some of its files is listed by its other files from then on.
        """
        kept = self._without(base, replaced)
        added = self.write_segments(base, df, whole)
        return self.commit(base, segments=[*kept, *added], written=self._counted(base, added, kept), **changes)

    def _without(self, base: Manifest, replaced: Sequence[str]) -> list[str]:
        gone = set(replaced)
        thinned = {s.rpartition("/")[0] for s in gone if _is_file(s)}
        kept: list[str] = []
        for s in base.segments:
            if s in gone:
                continue
            if s in thinned:
                leaves = self.files.child_files(f"{self._folder(base.table)}/{s}")
                kept += [f"{s}/{leaf}" for leaf in leaves if _is_file(leaf) and f"{s}/{leaf}" not in gone]
            else:
                kept.append(s)
        return kept

    @staticmethod
    def _counted(base: Manifest, added: Sequence[str], kept: Sequence[str]) -> dict[str, int]:
        alive = {s.split("/", 1)[0] for s in kept}
        counts = {v: n for v, n in base.written.items() if v in alive}
        for s in added:
            folder = s.split("/", 1)[0]
            counts[folder] = counts.get(folder, 0) + 1
        return counts

    def fit(self, base: Manifest, df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        """Match ``df`` to the table by column name and type.

        A column that ``df`` lacks takes its default; without a default the
        frame is refused, as is a column the table does not have.
        """
        given = {f.name.lower(): f.name for f in df.schema.fields}
        known = {c.name.lower() for c in base.columns} | {e.lower() for e in extra}
        surplus = [n for low, n in given.items() if low not in known]
        missing = [c.name for c in base.columns if c.name.lower() not in given and c.default is None]
        if surplus or missing:
            raise TableError(
                f"rows do not fit table '{base.table}'"
                + (f"; unknown columns: {', '.join(surplus)}" if surplus else "")
                + (f"; missing columns: {', '.join(missing)}" if missing else "")
            )
        out = []
        for c in base.columns:
            value = F.col(f"`{given[c.name.lower()]}`") if c.name.lower() in given else F.expr(c.default)
            out.append(_as_stored(value, c).alias(c.name))
        return df.select(*out, *[F.col(f"`{e}`") for e in extra])

    def _zone(self) -> str:
        return self.spark.conf.get("spark.sql.session.timeZone")

    @staticmethod
    def _zoned(base: Manifest) -> bool:
        """Whether directory names depend on the session's time zone."""
        return any(
            r.kind == "trunc" and isinstance(base.column(r.field).data_type, T.TimestampType) for r in base.layout.rules
        )

    def same_zone(self, base: Manifest) -> bool:
        """Whether directory names mean here what they meant to the writer."""
        return base.properties.get("time_zone", self._zone()) == self._zone()

    def write_segments(self, base: Manifest, df: DataFrame, whole: bool = True) -> list[str]:
        if not self.same_zone(base):
            raise LayoutError(
                f"table '{base.table}' is partitioned in time zone {base.properties['time_zone']}, the session is in {self._zone()}"
            )
        fitted = self.fit(base, df)
        columns = [F.col(f"`{c.name}`").alias(c.stored_as) for c in base.columns]
        columns += [r.value(F.col(f"`{r.field}`")).alias(r.column) for r in base.layout.rules if r.hidden]
        directories = [base.directory(r) for r in base.layout.rules]
        clusters = [base.column(c).stored_as for c in base.layout.cluster_by]
        rows = Layout.arrange(fitted.select(*columns), directories, clusters, whole, base.layout.curve)
        folder = f"{VERSION}={base.version + 1}-{uuid.uuid4().hex[:8]}"
        writer = rows.write.mode("errorifexists")
        if directories:
            writer = writer.partitionBy(*directories)
        writer.parquet(f"{self._folder(base.table)}/{folder}")
        found = [folder]
        for _ in directories:
            found = [f"{p}/{d}" for p in found for d in self.files.child_dirs(f"{self._folder(base.table)}/{p}")]
        return found

    def stage(self, df: DataFrame, path: str | None = None) -> DataFrame:
        """Compute ``df`` once, into the shared folder, and read it back.

        The written copy cuts the lineage and survives lost executors.
        """
        path = path or f"{self.root}/_staged/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextmanager
    def staged(self, df: DataFrame) -> Iterator[DataFrame]:
        """:meth:`stage` for the length of a ``with`` block."""
        path = f"{self.root}/_staged/{uuid.uuid4().hex}"
        try:
            yield self.stage(df, path)
        finally:
            self.files.delete(path)


# -- helpers -----------------------------------------------------------------
def numbered(located: DataFrame) -> DataFrame:
    """``located`` (read with ``located=True``) with a number in place of each file name.

    Joins and sorts then hold eight bytes a row instead of a path, which is longer than most keys.
    """
    return located.withColumn(FILE, F.crc32(F.substring_index(FILE, f"/{VERSION}=", -1)))


def touched_files(rows: DataFrame, located: DataFrame, most: Column | None = None) -> dict[str, int]:
    """Files that ``rows`` come from, with the maximum of ``most``; they were joined from ``located`` (see :func:`numbered`).

    One row per file reaches the driver, so clustering by key, which confines
    matches to few files, keeps both the list and the rewrite small. Names are looked up in the
    list of files that Spark made for the scan. If two files have one number, both count as touched:
    the other one is rewritten as it is.
    """
    found = {r[FILE]: r["most"] for r in rows.groupBy(FILE).agg(F.max(most if most is not None else F.lit(0)).alias("most")).collect()}
    inside = [path.rpartition(f"/{VERSION}=")[2] for path in (located.inputFiles() if found else ())]
    numbers = {file: zlib.crc32(file.encode()) for file in inside}
    return {unquote(f"{VERSION}={file}"): found[n] for file, n in numbers.items() if n in found}


def _is_file(segment: str) -> bool:
    return segment.endswith(".parquet")


def columns_of(schema: T.StructType) -> list[StoredColumn]:
    return [
        StoredColumn(
            name=f.name,
            stored_as=f.name,
            type=json.dumps(f.dataType.jsonValue()),
            comment=(f.metadata or {}).get("comment", ""),
        )
        for f in schema.fields
    ]


def _parse_type(text: str) -> T.DataType:
    as_field = {"name": "c", "type": json.loads(text), "nullable": True, "metadata": {}}
    return T.StructField.fromJson(as_field).dataType


def _collated(c: StoredColumn, collation: str) -> StoredColumn:
    if json.loads(c.type) != "string":
        return c
    return replace(c, type=json.dumps(f"string collate {COLLATIONS.get(collation, collation)}"))


def _as_stored(value: Column, c: StoredColumn) -> Column:
    """Cast to the declared type; round NUMERIC as declared; refuse NULL if required."""
    kind = c.data_type
    if c.rounding and isinstance(kind, T.DecimalType):
        rounder = F.bround if c.rounding == "ROUND_HALF_EVEN" else F.round
        value = rounder(value.cast(T.DecimalType(38, 18)), kind.scale)
    value = value.cast(kind)
    if c.required:
        message = f"column '{c.name}' is REQUIRED but holds NULL"
        value = F.when(value.isNull(), F.raise_error(F.lit(message)).cast(kind)).otherwise(value)
    return value
