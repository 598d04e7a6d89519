"""Streaming forms over the events table, replayed as daily files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tablecraft.operators.conversations import parse_messages
from tablecraft.operators.layout import Layout, time_partition
from tablecraft.sources.files import fresh_folder
from tablecraft.sources.warehouse import Warehouse
from tablecraft.streaming.folding import stream_fold
from tablecraft.streaming.microbatch import read_new_files, stream_incremental, stream_snapshot
from tablecraft.suite.registry import query, table
from tablecraft.suite.texts import FOLDED, messages

FILES_PER_BATCH = 12
RUN = dt.datetime(2024, 3, 1)


def daily_files(spark, sf_dir, columns):
    """The events as one file per day, in the shared folder."""
    folder = fresh_folder(spark, "arriving")
    events = table(spark, sf_dir, "events").select(*columns)
    day = F.col("ts").cast("date")
    events.withColumn("day", day).hint("rebalance", "day").write.partitionBy("day").parquet(folder)
    return f"{folder}/day=*", events.schema


@query("stream_append", "SELECT event_id, ts, event_type, value FROM events")
def stream_append(spark, sf_dir):
    path, schema = daily_files(spark, sf_dir, ["event_id", "ts", "event_type", "value"])
    warehouse = Warehouse(spark)
    stream = read_new_files(spark, path, schema, max_files=FILES_PER_BATCH)
    layout = Layout(rules=(time_partition("ts", "DAY"),))
    stream_incremental(stream, warehouse, "events", fresh_folder(spark, "stream"), layout=layout).awaitTermination()
    return warehouse.read("events")


@query("stream_merge", "SELECT user_id, event_type, MAX(event_id) AS event_id FROM events GROUP BY 1, 2")
def stream_merge(spark, sf_dir):
    """The latest event per user and type; each week's pairs arrive and are merged."""
    events = table(spark, sf_dir, "events")
    warehouse = Warehouse(spark)
    arriving = fresh_folder(spark, "weeks")
    for week in range(5):
        start = F.lit((dt.datetime(2024, 1, 1) + dt.timedelta(weeks=week)).isoformat()).cast("timestamp_ntz")
        this_week = (F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 7 DAYS"))
        pairs = events.where(this_week).groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
        pairs.write.mode("append").parquet(arriving)
        stream_incremental(
            read_new_files(spark, arriving, pairs.schema), warehouse, "latest", f"{arriving}-checkpoint",
            strategy="merge", unique_key=["user_id", "event_type"],
        ).awaitTermination()
    return warehouse.read("latest")


@query(
    "stream_scd",
    """
    WITH a AS (SELECT user_id, MAX(ts) AS updated_at, COUNT(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
    b AS (SELECT user_id, MAX(ts) AS updated_at, COUNT(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
    SELECT a.user_id, a.updated_at, a.n, TIMESTAMP '2024-03-01' AS dbt_valid_from,
           CASE WHEN b.user_id IS NOT NULL THEN TIMESTAMP '2024-03-02' END AS dbt_valid_to
    FROM a LEFT JOIN b ON a.user_id = b.user_id
    UNION ALL SELECT user_id, updated_at, n, TIMESTAMP '2024-03-02', NULL FROM b
    """,
)
def stream_scd(spark, sf_dir):
    """Two extracts of user activity arrive; each is one snapshot run."""
    events = table(spark, sf_dir, "events")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    arriving = fresh_folder(spark, "extracts")
    warehouse = Warehouse(spark)
    for half in (events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle)):
        extract = half.groupBy("user_id").agg(F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("n"))
        extract.write.mode("append").parquet(arriving)
        stream_snapshot(
            read_new_files(spark, arriving, extract.schema), warehouse, "users", f"{arriving}-checkpoint",
            "user_id", "updated_at", clock=lambda batch: RUN + dt.timedelta(days=batch),
        ).awaitTermination()
    return warehouse.read("users").select("user_id", "updated_at", "n", "dbt_valid_from", "dbt_valid_to")


@query("stream_conv_fold", f"WITH {FOLDED} SELECT * FROM f")
def stream_conv_fold(spark, sf_dir):
    """All messages arrive in three cuts across conversations and turns, a third of them twice; each cut is folded into what is there."""
    sent = messages(spark, sf_dir).withColumn("cut", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)))
    again = sent.where("cut = 0").withColumn("cut", F.lit(2).cast("long"))
    warehouse = Warehouse(spark)
    arriving = fresh_folder(spark, "messages")
    for cut in (2, 0, 1):
        sent.unionByName(again).where(F.col("cut") == cut).drop("cut").write.mode("append").parquet(arriving)
        stream = read_new_files(spark, arriving, "conv_id long, turn long, message string")
        typed = parse_messages(stream, "message", ["conv_id", "turn"])
        stream_fold(typed, warehouse, "folded", f"{arriving}-checkpoint", ["conv_id"], "turn").awaitTermination()
    return warehouse.read("folded").select(
        "conv_id", "answer", F.array_join("thoughts", "#").alias("thoughts"), "sql_text", F.coalesce("error", F.lit("-")).alias("error"))
