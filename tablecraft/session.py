"""Session settings the operators are written for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime re-planning: join choice by measured size, skew splits, coalescing.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # TIME columns are off by default.
    "spark.sql.timeType.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tablecraft", master: str | None = None, settings: Mapping[str, str] | None = None) -> SparkSession:
    """A session with these settings; shuffle partitions are left to the cluster.

    On a cluster set ``spark.sql.shuffle.partitions`` high (AQE joins small
    ones) and ``spark.checkpoint.dir`` to a folder all executors can reach.
    """
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
