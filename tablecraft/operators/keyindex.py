"""Which files hold which keys: a side table for merges of scattered keys.

Keys that are spread over a table at random defeat minima and maxima: each increment
would read the key columns of the whole table to find the files it must rewrite. A table
with a key index holds, beside each version folder, the hashes of its keys with the file each is in,
dealt into parts by hash. Version folders never change once written, so neither do their
indexes: a new folder gets its own, entries of files that are no longer listed are ignored,
and an index goes when its folder goes. An increment reads only the parts its hashes fall into, then
only the files found there; equal hashes of different keys cost a file read for nothing, never
a match.

    <table>/__version=7-1f3a9c2e/_keys-o_orderkey/4c0f21aa/of-64/part=17/....parquet
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, functions as F

from tablecraft.sources.warehouse import FILE, VERSION, Manifest, Warehouse

#: Table property that names the indexed key columns (as stored in files).
PROPERTY = "key_index"
#: Keys in a part of an index, and the most parts a folder's index has.
PART_ROWS, MOST_PARTS = 500_000, 4096


def index_keys(warehouse: Warehouse, name: str, keys: str | Sequence[str]) -> Manifest:
    """Give a table a key index; later increments on these keys use it and keep it up."""
    base = warehouse.manifest(name)
    stored = [base.column(k).stored_as for k in ([keys] if isinstance(keys, str) else keys)]
    done = warehouse.commit(base, properties={**base.properties, PROPERTY: stored})
    complete(warehouse, done, [base.column(k).name for k in ([keys] if isinstance(keys, str) else keys)])
    return done


def serves(base: Manifest, keys: Sequence[str]) -> bool:
    return base.properties.get(PROPERTY) == [base.column(k).stored_as for k in keys]


def _hashed(keys: Sequence[str]):
    return F.xxhash64(*[F.col(f"`{k}`") for k in keys])


def _place(base: Manifest, keys: Sequence[str], folder: str) -> str:
    return f"{folder}/_keys-{'-'.join(base.column(k).stored_as for k in keys)}"


def _found(warehouse: Warehouse, base: Manifest, keys: Sequence[str], folder: str) -> tuple[str, int] | None:
    """(path below the table, number of parts) of the folder's finished index."""
    root, place = warehouse._folder(base.table), _place(base, keys, folder)
    if not warehouse.files.exists(f"{root}/{place}"):
        return None
    for attempt in warehouse.files.child_dirs(f"{root}/{place}"):
        for of in warehouse.files.child_dirs(f"{root}/{place}/{attempt}"):
            if warehouse.files.exists(f"{root}/{place}/{attempt}/{of}/_SUCCESS"):
                return f"{place}/{attempt}/{of}", int(of.removeprefix("of-"))
    return None


def complete(warehouse: Warehouse, base: Manifest, keys: Sequence[str]) -> dict[str, tuple[str, int]]:
    """Index the version folders that have none yet; where every folder's index is.

    Only key columns of new folders are read, once.
    """
    out = {}
    by_folder: dict[str, list[str]] = {}
    for s in base.segments:
        by_folder.setdefault(s.split("/", 1)[0], []).append(s)
    for folder, segments in by_folder.items():
        found = _found(warehouse, base, keys, folder)
        if found is None:
            rows = warehouse.read(base.table, version=base.version, segments=segments, located=True, guarded=False)
            parts = max(1, min(MOST_PARTS, -(-rows.count() // PART_ROWS)))
            inside = F.regexp_extract(FILE, f"/({VERSION}=.*)$", 1).alias("file")
            pairs = rows.select(_hashed(keys).alias("hash"), inside).distinct().withColumn("part", F.pmod("hash", F.lit(parts)).cast("int"))
            path = f"{_place(base, keys, folder)}/{uuid.uuid4().hex[:8]}/of-{parts}"
            dealt = pairs.repartition(parts, "part").sortWithinPartitions("part", "hash")
            dealt.write.partitionBy("part").parquet(f"{warehouse._folder(base.table)}/{path}")
            found = (path, parts)
        out[folder] = found
    return out


def holding(warehouse: Warehouse, base: Manifest, rows: DataFrame, keys: Sequence[str], segments: Sequence[str]) -> list[str]:
    """Those files below ``segments`` that may hold a key of ``rows``.

    What reaches the driver are part numbers (at most ``MOST_PARTS``) and file names.
    """
    found = complete(warehouse, base, keys)
    root = warehouse._folder(base.table)
    for k in keys:
        rows = rows.where(F.col(f"`{k}`").isNotNull())
    typed = rows.select(*[F.col(f"`{k}`").cast(base.column(k).data_type).alias(k) for k in keys])
    hashes = typed.select(_hashed(keys).alias("hash")).distinct()
    wanted: dict[int, set[int]] = {}
    for parts in {parts for _, parts in found.values()}:
        wanted[parts] = {0} if parts == 1 else {r[0] for r in hashes.select(F.pmod("hash", F.lit(parts)).cast("int")).distinct().collect()}
    paths = []
    for path, parts in found.values():
        there = set(warehouse.files.child_dirs(f"{root}/{path}"))
        paths += [f"{root}/{path}/part={p}" for p in sorted(wanted[parts]) if f"part={p}" in there]
    if not paths:
        return []
    index = warehouse.spark.read.schema("hash long, file string").parquet(*paths)
    files = [unquote(r["file"]) for r in index.join(hashes, "hash", "left_semi").select("file").distinct().collect()]
    whole = {s for s in segments if not s.endswith(".parquet")}
    single = set(segments) - whole
    return sorted(f for f in files if f in single or re.sub(r"/[^/]*$", "", f) in whole)
