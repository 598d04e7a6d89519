"""Token counts from flat token files that have no index.

A token file is a run of ids in blocks of equal size; documents follow each other,
each ended by an end-of-document id, and run across block borders. Each block is
searched for that id in one vectorised comparison. A prefix scan over the blocks
of a file (tokens and separators before a block, last separator before it) then
turns places inside blocks into places in the file, and differences of places into
counts. Blocks are independent tasks; only three numbers per block are scanned.

Defined results: a null text is empty and counts 0; tokens after a file's last
separator are a document of their own, marked ``ended = false``; an empty table
gives no rows; repeated rows are counted each. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablecraft.llm.common import documents, fresh_folder, whole
from tablecraft.llm.tokens import encoder, public_path

END = 49407
BLOCK_TOKENS = 1 << 18
FILES = "file int, block long, data binary, doc_ids array<long>"
TOKENIZER = "word_bpe_49k.json"


def write_token_files(docs: DataFrame, folder: str, path: str, end: int = END, block_tokens: int = BLOCK_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the documents' ids as flat blocks (file, block, data, doc_ids).

    ``doc_ids`` names the documents that end in the block, in order; it holds no
    places. A file is what one task wrote. Special strings in a text are ordinary
    text, so ``end`` stands between documents only.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number = TaskContext.get().partitionId(), 0
        codes = encoder(path, True)
        mark = np.array([end], codes.dtype).tobytes()
        size = block_tokens * codes.dtype.itemsize
        held, ended = bytearray(), []

        def block(data: bytes, names: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([names], pa.list_(pa.int64()))],
                names=["file", "block", "data", "doc_ids"])

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), codes.encode(t or "" for t in batch.column(1).to_pylist()), strict=True):
                held += ids.tobytes()
                while len(held) >= size:
                    yield block(bytes(held[:size]), ended)
                    number, ended = number + 1, []
                    del held[:size]
                held += mark
                ended.append(name)
        if held:
            yield block(bytes(held), ended)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text")).mapInArrow(blocks, FILES)
    rows.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(FILES).parquet(folder)


def raw_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Token files of another origin, one block each: Spark reads a file of up to 2 GB as a row."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("file"), F.lit(0).cast("long").alias("block"), F.col("content").alias("data"))


def scan(blocks: DataFrame, end: int = END, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document in the files; ordinals count from 0 in each file."""
    kind = blocks.schema["file"].dataType.simpleString()
    found = f"file {kind}, block long, n_tokens long, ends array<long>"

    def separators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(data or b"", dtype) for data in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([np.flatnonzero(x == end).tolist() for x in ids], pa.list_(pa.int64()))], names=["file", "block", "n_tokens", "ends"])

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    # The separator before a block, and how far the file goes, by one pass in block order.
    placed = (
        blocks.select("file", "block", "data").mapInArrow(separators, found)
        .withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        .withColumn("first_ordinal", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long"))
        .withColumn("last_end", F.max(F.col("first_token") + F.array_max("ends")).over(upto)))
    shifted = placed.withColumn("end_before", F.coalesce(F.lag("last_end").over(Window.partitionBy("file").orderBy("block")), F.lit(-1)))
    absolute = shifted.withColumn("at", F.transform("ends", lambda e: e + F.col("first_token")))
    ended = absolute.select("file", "first_ordinal", F.posexplode(F.arrays_zip("at", F.concat(F.array("end_before"), F.col("at")).alias("previous"))).alias("i", "x"))
    closed = ended.where("x.at is not null").select("file", (F.col("first_ordinal") + F.col("i")).alias("ordinal"), (F.col("x.at") - F.col("x.previous") - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    tails = shifted.groupBy("file").agg(
        F.sum(F.size("ends")).cast("long").alias("ordinal"),
        (F.sum("n_tokens") - 1 - F.coalesce(F.max("last_end"), F.lit(-1))).alias("n_tokens"), F.lit(False).alias("ended"))
    return closed.unionByName(tails.where("n_tokens > 0"))


def names(blocks: DataFrame) -> DataFrame:
    """(file, ordinal, doc_id) of files that :func:`write_token_files` wrote."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = blocks.select("file", "block", "doc_ids").withColumn("first", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0)).cast("long"))
    return counted.select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = write_token_files(documents(spark, sf_dir), fresh_folder(spark, "tokens"), public_path(TOKENIZER))
    return scan(blocks).join(names(blocks), ["file", "ordinal"]).select("doc_id", "n_tokens")
