"""Order-free digests of a history's open rows, so that a snapshot run joins only what differs.

Keys are dealt into ``BUCKETS`` buckets by hash. A bucket's digest is how many
rows it has and two sums of hashes over (key, time): the same for any order of rows. Where
source and open rows have equal digests, every key has one open row of its newest time and no
key is new or gone, so a run has nothing to do there. Sums of hashes can be added to and taken
from: the digests of the next version are the old ones, less what a run closes, plus what it opens.

Digests are stored beside the table and named, with a fingerprint of the directories they
are about, in the manifest that they belong to. If something else wrote the history
since, the fingerprint differs and they are computed from the open rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablecraft.sources.warehouse import Manifest, Warehouse

BUCKETS = 4096
#: Table property: folder of the digests and the fingerprint of what they are about.
PROPERTY = "open_digests"
_SUM = T.DecimalType(38, 0)


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def digest(rows: DataFrame, sign: int = 1) -> DataFrame:
    """(bucket, n, s, t) of rows (key, time); rows with a NULL key are left out."""
    key, time = (F.col(f"`{c}`") for c in rows.columns[:2])
    hashes = [F.xxhash64(F.lit(i), key, time, time.isNull()).cast(_SUM) for i in (0, 1)]
    found = rows.where(key.isNotNull()).groupBy(bucket(key).alias("bucket")).agg(F.count("*").alias("n"), *[F.sum(h).cast(_SUM).alias(c) for c, h in zip("st", hashes)])
    return found if sign > 0 else found.select("bucket", *[(-F.col(c)).cast(found.schema[c].dataType).alias(c) for c in "nst"])


def added(*parts: DataFrame) -> DataFrame:
    """Digests of rows together; a digest with negative numbers takes away."""
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    sums = together.groupBy("bucket").agg(F.sum("n").cast("long").alias("n"), *[F.sum(c).cast(_SUM).alias(c) for c in "st"])
    return sums.where("n <> 0 OR s <> 0 OR t <> 0")


def differing(a: DataFrame, b: DataFrame) -> list[int]:
    """Buckets whose digests differ: at most ``BUCKETS`` numbers."""
    minus = b.select("bucket", *[(-F.col(c)).cast(b.schema[c].dataType).alias(c) for c in "nst"])
    return sorted(r["bucket"] for r in added(a, minus).select("bucket").collect())


def fingerprint(segments: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(segments)).encode()).hexdigest()


def stored(warehouse: Warehouse, base: Manifest, segments: Sequence[str], key: str, opened: DataFrame) -> DataFrame:
    """The digests of the open rows (key, time) in ``segments``, read if they are still about these."""
    known = base.properties.get(PROPERTY) or {}
    if known.get("of") == fingerprint(segments) and known.get("key") == key and warehouse.files.exists(f"{warehouse._folder(base.table)}/{known['folder']}/_SUCCESS"):
        return warehouse.spark.read.schema(f"bucket int, n long, s {_SUM.simpleString()}, t {_SUM.simpleString()}").parquet(f"{warehouse._folder(base.table)}/{known['folder']}")
    return digest(opened)


def keep(warehouse: Warehouse, base: Manifest, digests: DataFrame) -> str:
    """Write digests beside the table; the folder's name."""
    folder = f"_digests/{uuid.uuid4().hex[:12]}"
    digests.coalesce(1).write.parquet(f"{warehouse._folder(base.table)}/{folder}")
    return folder


def named(folder: str, key: str, segments: Sequence[str]) -> dict[str, str]:
    return {"folder": folder, "key": key, "of": fingerprint(segments)}
