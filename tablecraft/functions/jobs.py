"""SQL jobs: one statement, or a script run as a unit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession


class JobError(ValueError):
    """SQL that Spark refuses."""


def run_sql(spark: SparkSession, sql: str, args: Mapping[str, Any] | None = None, **frames: DataFrame) -> DataFrame:
    """Analyse a statement and return its lazy result; refuse it if invalid."""
    if not sql.strip():
        raise JobError("the SQL is empty")
    try:
        return spark.sql(sql, args=dict(args or {}), **frames)
    except (AnalysisException, ParseException) as err:
        raise JobError(f"SQL is invalid: {err}") from err


def run_script(spark: SparkSession, statements: Sequence[str] | str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """Run statements in order as one ``BEGIN ... END`` block.

    A failing statement ends the script. The result is that of the last query.
    """
    parts = [statements] if isinstance(statements, str) else list(statements)
    body = "\n".join(p.strip().rstrip(";") + ";" for p in parts if p.strip())
    if not body:
        raise JobError("the script is empty")
    try:
        return spark.sql(f"BEGIN\n{body}\nEND", args=dict(args or {}))
    except (AnalysisException, ParseException) as err:
        raise JobError(f"script is invalid: {err}") from err
