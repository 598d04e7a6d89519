"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.sources.files import fresh_folder


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared folder and read again.

    This cuts lineage: a lost executor costs a re-read, not a recomputation, and
    every reader sees the same rows.
    """
    spark = frame.sparkSession
    folder = fresh_folder(spark, purpose)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def whole(text: Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(frame: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of the frame has that name."""
    taken = {name.lower() for name in frame.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
