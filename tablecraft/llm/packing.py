"""Packing tokenized documents into sequences by patterns of lengths.

Only the histogram of piece lengths (at most ``size`` numbers) reaches the driver.
There, patterns of up to three lengths that fill a sequence are enumerated, and
non-negative least squares says how often each is repeated so that together they
use up the histogram. The patterns that the solution leans on are kept, solved
again, rounded and taken from the histogram; what is left is packed best fit, by
length and count. The result is a table of slots: from which rank on do the pieces
of a length go to which sequences, at which offset.

Pieces get their rank within their length in two steps, within (length, slice) and
by running sums over slices, so that a length with very many pieces is ranked by
many tasks. A look-up in the slot table then places each piece.

Defined results: a null text is empty; an empty text is one piece of the end id;
repeated rows are packed each; an empty table gives no rows; ties in length are
ranked by id, piece and contents; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablecraft.llm.common import documents, stored, whole
from tablecraft.llm.tokens import encoder, public_path

SIZE = 2048
TOKENIZER = "word_bpe_49k.json"
#: Steps of the least-squares solver over all patterns, and over those kept.
STEPS = (60, 400)
#: Patterns kept for each length.
KEPT = 3
#: Unused tokens that a pattern may leave in a sequence.
SLACK = 16
#: Pieces of a length that one task ranks, about.
RANKED_TOGETHER = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = 0, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Token pieces of every document: its ids, then ``end``; only longer ones are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for name, ids in zip(batch.column(0).to_pylist(), codes.encode(t or "" for t in batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.array([end])).astype("<u4")
                for number, start in enumerate(range(0, len(ids), size)):
                    part = ids[start:start + size]
                    for column, value in zip(rows, (name, number, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if keep_ids else None), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text")).mapInArrow(cut, PIECES)


def patterns(counts: np.ndarray, size: int, slack: int = SLACK) -> np.ndarray:
    """Length patterns (a <= b <= c, 0 where fewer) that leave at most ``slack`` tokens.

    For two lengths the third is the longest that is present and fits, so there are
    at most ``size ** 2 / 2`` of them whatever the corpus.
    """
    present = np.flatnonzero(counts)
    present = present[present < size]
    longest = np.zeros(size + 1, np.int64)
    longest[present] = present
    longest = np.maximum.accumulate(longest)
    found = []
    for b in present:
        if b * 2 <= size:
            third = longest[size - b] if size - b > 0 else 0
            if third >= b and b + third >= size - slack:
                found.append((0, b, third))
        a = present[(present <= b) & (present + 2 * b <= size)]
        if len(a):
            c = longest[size - b - a]
            good = (c >= b) & (a + b + c >= size - slack)
            found.extend(np.stack([a[good], np.full(good.sum(), b), c[good]], 1).tolist())
    return np.array(sorted(set(map(tuple, found))), np.int64).reshape(-1, 3)


def least_squares(shapes: np.ndarray, counts: np.ndarray, steps: int, start: np.ndarray | None = None) -> np.ndarray:
    """Non-negative repeats whose used lengths come nearest to the counts, by multiplicative steps."""
    n = len(counts)
    target = counts.astype(float)
    target[0] = 0
    used = lambda x: sum((np.bincount(shapes[:, k], x, n) for k in range(3)), np.zeros(n))

    def back(y: np.ndarray) -> np.ndarray:
        y[0] = 0
        return y[shapes[:, 0]] + y[shapes[:, 1]] + y[shapes[:, 2]]

    wanted = back(target.copy())
    x = start if start is not None else np.full(len(shapes), target.sum() / max(1, 3 * len(shapes)))
    for _ in range(steps):
        x = x * wanted / np.maximum(back(used(x)), 1e-12)
    return x


def _kept(shapes: np.ndarray, x: np.ndarray, kept: int) -> np.ndarray:
    """For each length, the patterns with the largest repeats that use it."""
    chosen = np.zeros(len(shapes), bool)
    for k in range(3):
        order = np.lexsort((-x, shapes[:, k]))
        lengths = shapes[order, k]
        first = np.r_[0, np.flatnonzero(np.diff(lengths)) + 1] if len(lengths) else np.zeros(0, int)
        place = np.arange(len(lengths)) - np.repeat(first, np.diff(np.r_[first, len(lengths)]))
        chosen[order[(place < kept) & (lengths > 0)]] = True
    return chosen


def plan(histogram: Mapping[int, int], size: int = SIZE) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Groups of equal sequences: ((length, times), ...) and how many of them.

    Uses every piece of the histogram exactly once.
    """
    counts = np.zeros(size + 1, np.int64)
    for length, count in histogram.items():
        counts[length] = count
    groups: list[tuple[tuple[tuple[int, int], ...], int]] = []
    shapes = patterns(counts, size)
    if len(shapes):
        x = least_squares(shapes, counts, STEPS[0])
        chosen = _kept(shapes, x, KEPT)
        shapes, x = shapes[chosen], x[chosen]
        x = least_squares(shapes, counts, STEPS[1], np.maximum(x, 1e-6))
        for k in np.argsort(-x, kind="stable"):
            lengths, each = np.unique(shapes[k][shapes[k] > 0], return_counts=True)
            times = int(min(round(float(x[k])), (counts[lengths] // each).min()))
            if times > 0:
                counts[lengths] -= each * times
                groups.append((tuple(zip(lengths.tolist(), each.tolist(), strict=True)), times))
    return groups + _best_fit(counts, size)


def _best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, longest first, over (length, count) instead of single pieces."""
    open_: dict[int, list[list]] = {}
    room = np.zeros(size + 1, bool)

    def put(contents: tuple, free: int, times: int) -> None:
        open_.setdefault(free, []).append([contents, times])
        room[free] = True

    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(room[length:])
            if len(fits):
                free = length + int(fits[0])
                contents, times = open_[free][-1]
                each = min(free // length, max(1, left // times))
                take = min(times, left)
                if take == times:
                    open_[free].pop()
                    room[free] = bool(open_[free])
                else:
                    open_[free][-1][1] -= take
                left -= take * each
                put((*contents, (length, each)), free - length * each, take)
            else:
                each = min(size // length, left)
                take = left // each
                left -= take * each
                put(((length, each),), size - length * each, take)
    return [(contents, times) for groups in open_.values() for contents, times in groups]


def slots(groups: list[tuple[tuple[tuple[int, int], ...], int]], size: int = SIZE) -> dict[str, np.ndarray]:
    """Look-up table sorted by (length, first rank): sequence and offset of that rank."""
    used = np.zeros(size + 1, np.int64)
    rows = []
    sequence = 0
    for contents, times in groups:
        offset = 0
        for length, each in contents:
            for _ in range(each):
                rows.append((length, int(used[length]), sequence, offset))
                used[length] += times
                offset += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``cut`` is read several times: store it first."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    table = spark.sparkContext.broadcast(slots(plan(histogram, size), size))
    slices = max(8, -(-max(histogram.values(), default=0) // RANKED_TOGETHER))
    sliced = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sliced.groupBy("length", "slice").count().select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = sliced.withColumn("rank", F.row_number().over(inside) - 1).join(bases, ["length", "slice"]).withColumn("rank", F.col("rank") + F.col("base")).drop("slice", "base")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        wide = np.int64(1) << 44
        keys = t["length"] * wide + t["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(t["sequence"][at] + rank - t["rank"][at]), pa.array(t["offset"][at])],
                names=[*batch.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in ranked.dtypes)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long").drop("rank")


def packed(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Where every piece of every document goes, without the ids."""
    return pack(stored(pieces(docs, path, size, keep_ids=False).drop("ids"), "pieces"), size)


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), public_path(TOKENIZER))
