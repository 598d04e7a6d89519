"""Drift between declared and live columns, and the output contract of a model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.plans.schema import Field, clean, live_type, same_type


class ContractError(ValueError):
    """A model result that breaks its contract."""


@dataclass(frozen=True)
class Finding:
    column: str
    kind: str
    declared: str | None
    actual: str | None


def drift_findings(fields: Sequence[Field], df: DataFrame) -> list[Finding]:
    """Extra, missing and type-mismatched columns; names ignore case."""
    live = {f.name.lower(): f for f in df.schema.fields}
    declared = {f.name.lower(): f for f in clean(fields)}
    out: list[Finding] = []
    for low, f in declared.items():
        if low not in live:
            out.append(Finding(f.name, "missing", f.canonical, None))
        elif not same_type(f, live[low].dataType):
            out.append(Finding(f.name, "type_mismatch", f.canonical, live_type(live[low].dataType)))
    out += [
        Finding(f.name, "extra", None, live_type(f.dataType)) for low, f in live.items() if low not in declared
    ]
    return out


def drift(fields: Sequence[Field], df: DataFrame, counts: bool = True) -> DataFrame:
    """The drift report, with how much data each finding concerns.

    Without ``counts`` only column lists are compared, and no data are read.

    ``affected_rows`` counts the values of an extra or mismatched column and
    all rows for a missing one. One scan, however many findings.
    """
    found = drift_findings(fields, df)
    if not counts:
        uncounted = _with_counts(df.limit(0), found)
        return uncounted.withColumn("affected_rows", F.lit(None).cast(uncounted.schema["affected_rows"].dataType))
    return _with_counts(df, found)


def file_drift(fields: Sequence[Field], spark: SparkSession, path: str) -> DataFrame:
    """Drift of a folder of parquet files written at different times.

    Spark merges the footers of all files in a distributed job, so a column
    that only some files have is reported as well.
    """
    return drift(fields, spark.read.option("mergeSchema", True).parquet(path))


def contract_findings(
    df: DataFrame,
    declared: Sequence[Field] | None = None,
    unique_key: Sequence[str] | str = (),
    partition_field: str | None = None,
    cluster_by: Sequence[str] | str = (),
) -> list[Finding]:
    """What breaks the contract of a model result.

    Key, partition and cluster columns must exist. With a declared schema,
    undeclared and mismatched columns are findings, and so are missing ones
    unless they are REPEATED or still to be inserted.
    """
    live = {f.name.lower(): f for f in df.schema.fields}
    uses = [("unique_key", n) for n in ([unique_key] if isinstance(unique_key, str) else unique_key)]
    uses += [("partition_by", partition_field)] if partition_field else []
    uses += [("cluster_by", n) for n in ([cluster_by] if isinstance(cluster_by, str) else cluster_by)]
    out = [Finding(n, f"{what}_not_found", None, None) for what, n in uses if n.lower() not in live]
    if declared is None:
        return out
    known = {f.name.lower(): f for f in declared if f.alter != "delete"}
    out += [
        Finding(f.name, "undeclared", None, live_type(f.dataType)) for low, f in live.items() if low not in known
    ]
    for low, f in known.items():
        if low in live:
            if not same_type(f, live[low].dataType):
                out.append(Finding(f.name, "type_mismatch", f.canonical, live_type(live[low].dataType)))
        elif not f.repeated and f.alter != "insert":
            out.append(Finding(f.name, "missing", f.canonical, None))
    return out


def check_contract(df: DataFrame, **contract) -> None:
    """Raise with every finding; call it before the result is written."""
    found = contract_findings(df, **contract)
    if found:
        available = ", ".join(df.columns)
        lines = [
            f"  - {f.column}: {f.kind}" + (f" (declared {f.declared}, actual {f.actual})" if f.declared or f.actual else "")
            for f in found
        ]
        raise ContractError("contract broken:\n" + "\n".join(lines) + f"\n  available: {available}")


def contract_report(df: DataFrame, **contract) -> DataFrame:
    """The findings as rows, with how much data each one concerns."""
    return _with_counts(df, contract_findings(df, **contract))


def _with_counts(df: DataFrame, findings: Sequence[Finding]) -> DataFrame:
    if not findings:
        return df.sparkSession.createDataFrame(
            [], "column_name string, kind string, declared string, actual string, affected_rows bigint"
        )
    live = {c.lower(): c for c in df.columns}
    counts = [F.count(F.lit(1)).alias("total")]
    counts += [F.count(F.col(f"`{live[f.column.lower()]}`")).alias(f"n{i}") for i, f in enumerate(findings) if f.column.lower() in live]
    one_row = df.agg(*counts)
    rows = F.array(*[
        F.struct(
            F.lit(f.column).alias("column_name"),
            F.lit(f.kind).alias("kind"),
            F.lit(f.declared).cast("string").alias("declared"),
            F.lit(f.actual).cast("string").alias("actual"),
            F.col(f"n{i}" if f.column.lower() in live else "total").alias("affected_rows"),
        )
        for i, f in enumerate(findings)
    ])
    return one_row.select(F.explode(rows).alias("r")).select("r.*")
