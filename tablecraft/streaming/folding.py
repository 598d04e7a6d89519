"""Conversations folded while their messages arrive, in any order and any cut.

Each conversation is a keyed state: its messages by place (turn). A message that comes again
changes nothing; if a place comes with different contents, the greater one stays, whichever
came first, so the result does not depend on how the stream was cut. After every
micro-batch the conversations it touched are folded anew and merged into the stored table,
once per batch id. The row equals the one :func:`fold_conversations` makes of all messages
so far.

With ``quiet`` a timer runs for every conversation; when no message came for that long its
messages leave the state and it is closed. Timers need a stream that goes on (Spark never calls one
with timers finished), so the trigger is then a processing time. What comes later for a closed conversation, or
comes without a key, is not folded and not lost: it is appended to ``<table>_late``.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tablecraft.operators import incremental as inc
from tablecraft.operators.layout import Layout
from tablecraft.sources.warehouse import Warehouse
from tablecraft.streaming.microbatch import _once, _start, stream_identity

TYPED = ("error", "sqls", "answer_parts", "thoughts")
LATE = "__late"
# Fixed value: the state store that keyed state with timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fold_messages(messages: Sequence[str]) -> tuple[str, list[str], str, str | None]:
    """(answer, thoughts, sql_text, error) of messages in order, each a JSON array of the ``TYPED`` columns."""
    answer, thoughts, sqls, error = "", [], [], None
    for text in messages:
        (last_error,), some_sql, parts, more = json.loads(text)
        for part in parts:
            answer = f"{answer} {part}" if answer else part
        thoughts += more
        sqls += some_sql
        error = last_error if last_error is not None else error
    return answer, thoughts, "\n".join(sqls), error


class FoldProcessor(StatefulProcessor):
    """Messages by place, per conversation; see the module."""

    def __init__(self, keys: Sequence[str], columns: Sequence[str], quiet_ms: int | None):
        self.keys, self.columns, self.quiet_ms = list(keys), list(columns), quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getMapState("messages", "place long", "message string")
        self.closed = handle.getValueState("closed", "closed boolean")

    def _late(self, key: tuple, place: int | None, message: str) -> dict:
        return {**dict(zip(self.keys, key)), "answer": None, "thoughts": None, "sql_text": None, "error": None, LATE: True, "place": place, "message": message}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        shut = any(k is None for k in key) or self.closed.exists()
        out, changed = [], False
        for frame in rows:
            for place, message in zip(frame.iloc[:, -2], frame.iloc[:, -1]):
                place = None if pd.isna(place) else int(place)
                if shut or place is None:
                    out.append(self._late(key, place, message))
                    continue
                known = self.messages.getValue((place,)) if self.messages.containsKey((place,)) else None
                if known is None or known[0] < message:
                    self.messages.updateValue((place,), (message,))
                    changed = True
        if self.quiet_ms is not None and not shut:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        if changed:
            ordered = sorted((place[0], message[0]) for place, message in self.messages.iterator())
            answer, thoughts, sql_text, error = fold_messages([m for _, m in ordered])
            out.append({**dict(zip(self.keys, key)), "answer": answer, "thoughts": thoughts, "sql_text": sql_text, "error": error, LATE: False, "place": None, "message": None})
        yield pd.DataFrame(out, columns=self.columns).astype({"place": "Int64"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.messages.clear()
        self.closed.update((True,))
        yield pd.DataFrame(columns=self.columns).astype({"place": "Int64"})

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession):
    """The session's state store while a query starts; the query keeps it, the session does not."""
    name, wanted = PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def folded_stream(messages: DataFrame, keys: Sequence[str], order_by: str, quiet: dt.timedelta | None = None) -> DataFrame:
    """A stream of folded rows, one for every conversation that a micro-batch changed, and of late messages."""
    # Columns of different types make no array in SQL, so their JSON forms are joined; the error is an array of one.
    message = F.concat(F.lit("["), F.to_json(F.array("error")), *[p for c in TYPED[1:] for p in (F.lit(","), F.coalesce(F.to_json(F.col(c)), F.lit("[]")))], F.lit("]"))
    narrow = messages.select(*keys, F.col(order_by).cast("long").alias("__place"), message.alias("__message"))
    schema = T.StructType([
        *[messages.schema[k] for k in keys], T.StructField("answer", T.StringType()), T.StructField("thoughts", T.ArrayType(T.StringType())),
        T.StructField("sql_text", T.StringType()), T.StructField("error", T.StringType()), T.StructField(LATE, T.BooleanType()),
        T.StructField("place", T.LongType()), T.StructField("message", T.StringType())])
    quiet_ms = None if quiet is None else int(quiet.total_seconds() * 1000)
    return narrow.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=FoldProcessor(keys, schema.names, quiet_ms), outputStructType=schema, outputMode="Update",
        timeMode="None" if quiet_ms is None else "ProcessingTime")


def stream_fold(
    messages: DataFrame,
    warehouse: Warehouse,
    name: str,
    checkpoint: str,
    keys: Sequence[str],
    order_by: str,
    quiet: dt.timedelta | None = None,
    layout: Layout | None = None,
    trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Keep ``name`` at one folded row per conversation of a stream of typed messages."""
    if quiet is not None and "processingTime" not in (trigger or {"processingTime": ""}):
        raise ValueError("quiet needs a processingTime trigger: a stream with timers does not end by itself")
    folded = folded_stream(messages, keys, order_by, quiet)
    trigger = trigger or ({"availableNow": True} if quiet is None else {"processingTime": "10 seconds"})

    def work(batch: DataFrame, batch_id: int, batches: dict[str, int]) -> None:
        with warehouse.staged(batch) as rows:
            late = rows.where(F.col(LATE)).select(*keys, F.col("place").alias(order_by), "message")
            if not late.isEmpty():
                beside = f"{name}_late"
                seen = warehouse.manifest(beside).batches if warehouse.exists(beside) else {}
                if any(seen.get(stream, -1) < number for stream, number in batches.items()):
                    put = warehouse.append if warehouse.exists(beside) else warehouse.create
                    put(beside, late, batches=batches)
            found = rows.where(~F.col(LATE)).select(*keys, "answer", "thoughts", "sql_text", "error")
            if found.isEmpty() and warehouse.exists(name):
                return
            if not warehouse.exists(name):
                warehouse.create(name, found, layout, batches=batches)
            else:
                inc.merge(warehouse, name, found, list(keys), batches=batches)

    handle = _once(warehouse, name, lambda: stream_identity(warehouse, checkpoint), work)
    with _state_store(warehouse.spark):
        return _start(folded, checkpoint, handle, trigger, mode="update")
