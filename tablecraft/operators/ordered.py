"""Ordered text aggregation that never gathers a hot group's rows in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

CHUNK = "__chunk"


def with_chunks(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """Tag rows with a chunk number that never decreases in ``order_by``.

    By default chunks are the partitions of a range exchange on keys and order:
    balanced by sampling, so a key with a third of all rows covers a third of
    the partitions. ``chunk`` replaces this with an expression of the caller's
    (it must be non-decreasing in ``order_by``), which saves the sampling pass.
    Without an order the input partitions serve as they are.
    """
    if chunk is not None:
        return df.withColumn(CHUNK, chunk)
    if not order_by:
        return df.withColumn(CHUNK, F.spark_partition_id())
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order_by)])
    return ranged.withColumn(CHUNK, F.spark_partition_id())


def join_sorted(entries: Column, delimiter: str | None) -> Column:
    """Join the ``value`` of sorted structs; NULL when nothing is there.

    Without a delimiter the values are arrays and become one array.
    """
    values = F.transform(F.array_sort(entries), lambda e: e["value"])
    joined = F.flatten(values) if delimiter is None else F.array_join(values, delimiter)
    return F.when(F.size(values) > 0, joined)


def fold_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    outputs: Mapping[str, tuple[Column, str | None]],
    chunk: Column | None = None,
    extra: Mapping[str, tuple[Column, Column]] | None = None,
) -> DataFrame:
    """Per key, join text (or arrays) in order: ``outputs = {name: (value, delimiter)}``.

    Two steps. Rows are joined per (key, chunk), where a chunk is bounded; then
    the few chunk texts of a key are joined in chunk order. NULL values are
    skipped and a key without values gets NULL. ``extra`` adds aggregates that
    combine: ``{name: (per_chunk, over_chunks_of_column_name)}``.
    """
    extra = extra or {}
    tagged = with_chunks(df, keys, order_by, chunk)
    order = [F.col(c) for c in order_by]
    position = [o.alias(f"o{i}") for i, o in enumerate(order)]
    per_chunk = [
        join_sorted(
            F.collect_list(F.when(value.isNotNull(), F.struct(*position, value.alias("value")))), delimiter
        ).alias(name)
        for name, (value, delimiter) in outputs.items()
    ] + [first.alias(name) for name, (first, _) in extra.items()]
    chunks = tagged.groupBy(*keys, CHUNK).agg(*per_chunk)
    whole = [
        join_sorted(
            F.collect_list(F.when(F.col(name).isNotNull(), F.struct(F.col(CHUNK), F.col(name).alias("value")))),
            delimiter,
        ).alias(name)
        for name, (_, delimiter) in outputs.items()
    ] + [last.alias(name) for name, (_, last) in extra.items()]
    return chunks.groupBy(*keys).agg(*whole)
