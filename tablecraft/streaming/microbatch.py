"""Incremental models and snapshots fed by Structured Streaming.

Each micro-batch is one run of the batch operator. The batch id is stored in
the same manifest as the rows, so a batch replayed after a failure is skipped. Ids
are kept by the identity of the query that Spark stores in its checkpoint: two
streams into one table, or a new checkpoint, never pass for one another.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablecraft.operators import incremental as inc
from tablecraft.operators.layout import Layout
from tablecraft.operators.snapshot import snapshot_run
from tablecraft.sources.warehouse import Warehouse


def read_new_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(path)


def stream_identity(warehouse: Warehouse, checkpoint: str) -> str:
    """The id of the query that a checkpoint belongs to."""
    return json.loads(warehouse.files.read_text(f"{checkpoint.rstrip('/')}/metadata"))["id"]


def _once(warehouse: Warehouse, name: str, identity: Callable[[], str], work: Callable[[DataFrame, int, dict[str, int]], Any]):
    """Run ``work`` for a batch unless the table has it already."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        stream = identity()
        done = warehouse.manifest(name).batches if warehouse.exists(name) else {}
        if done.get(stream, -1) >= batch_id:
            return
        work(batch, batch_id, {stream: batch_id})

    return handle


def stream_incremental(
    source: DataFrame,
    warehouse: Warehouse,
    name: str,
    checkpoint: str,
    strategy: str = "append",
    unique_key: str | Sequence[str] | None = None,
    layout: Layout | None = None,
    trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Feed a stored table from a stream with any incremental strategy.

    The first batch creates the table if there is none. The default trigger
    takes what is available and stops.
    """

    def work(batch: DataFrame, batch_id: int, batches: dict[str, int]) -> None:
        if not warehouse.exists(name):
            warehouse.create(name, batch, layout, batches=batches)
        else:
            inc.apply_strategy(warehouse, name, batch, strategy, unique_key, batches=batches)

    return _start(source, checkpoint, _once(warehouse, name, lambda: stream_identity(warehouse, checkpoint), work), trigger)


def stream_snapshot(
    source: DataFrame,
    warehouse: Warehouse,
    name: str,
    checkpoint: str,
    key: str,
    updated_at: str,
    clock: Callable[[int], dt.datetime],
    invalidate_hard_deletes: bool = False,
    trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Version every micro-batch: each one is a snapshot run at ``clock(batch_id)``.

    ``invalidate_hard_deletes`` makes sense only if a batch is a full extract.
    """

    def work(batch: DataFrame, batch_id: int, batches: dict[str, int]) -> None:
        snapshot_run(
            warehouse, name, batch, key, updated_at, clock(batch_id),
            invalidate_hard_deletes=invalidate_hard_deletes, batches=batches,
        )

    return _start(source, checkpoint, _once(warehouse, name, lambda: stream_identity(warehouse, checkpoint), work), trigger)


def _start(source: DataFrame, checkpoint: str, handle, trigger: dict[str, Any] | None, mode: str = "append") -> StreamingQuery:
    return (
        source.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
