"""User-defined functions: scalar, table-valued, Python, and procedures."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablecraft.plans.schema import Field, canonical_type

# Argument modes and determinism levels.
MODES = ("IN", "OUT", "INOUT")
DETERMINISM = ("DETERMINISM_LEVEL_UNSPECIFIED", "DETERMINISTIC", "NOT_DETERMINISTIC")


class RoutineError(ValueError):
    """A routine that is declared or called in a way that is not allowed."""


@dataclass(frozen=True)
class Argument:
    name: str
    type: str
    mode: str = "IN"

    def spark_name(self) -> str:
        return _spark_name(self.type)


def _spark_name(declared: str) -> str:
    """Warehouse type names become Spark ones; Spark names pass unchanged."""
    if canonical_type(declared) in ("UNKNOWN", "STRUCT"):
        return declared
    return Field("x", declared).spark_type().simpleString()


def _signature(args: Sequence[Argument]) -> str:
    return ", ".join(f"{a.name} {a.spark_name()}" for a in args)


def _check(name: str, body: str, args: Sequence[Argument]) -> None:
    if not name or not body.strip():
        raise RoutineError("a routine needs a name and a body")
    for a in args:
        if a.mode not in MODES:
            raise RoutineError(f"argument '{a.name}' of '{name}' has unknown mode '{a.mode}'")


def create_function(
    spark: SparkSession, name: str, args: Sequence[Argument], body: str, returns: str | None = None,
    description: str = "", deterministic: bool = True, temporary: bool = True,
) -> None:
    """A SQL scalar function. Catalyst inlines the body into each query.

    A function that is not temporary is kept in the catalog.
    """
    _check(name, body, args)
    result = f" RETURNS {_spark_name(returns)}" if returns else ""
    spark.sql(
        f"CREATE OR REPLACE {_kept(temporary)}FUNCTION {name}({_signature(args)}){result}{_traits(description, deterministic)} RETURN {body}"
    )


def create_table_function(
    spark: SparkSession, name: str, args: Sequence[Argument], query: str,
    returns: Sequence[Argument], description: str = "", deterministic: bool = True, temporary: bool = True,
) -> None:
    """A SQL function that returns a table; the query is inlined as well."""
    _check(name, query, args)
    spark.sql(
        f"CREATE OR REPLACE {_kept(temporary)}FUNCTION {name}({_signature(args)}) RETURNS TABLE({_signature(returns)})"
        f"{_traits(description, deterministic)} RETURN {query}"
    )


def _kept(temporary: bool) -> str:
    return "TEMPORARY " if temporary else ""


def _traits(description: str, deterministic: bool) -> str:
    comment = " COMMENT '" + description.replace("'", "\\'") + "'" if description else ""
    return comment + ("" if deterministic else " NOT DETERMINISTIC")


def create_python_function(
    spark: SparkSession,
    name: str,
    function: Callable,
    returns: str | T.DataType,
    determinism: str = "DETERMINISTIC",
    libraries: Sequence[str] = (),
) -> Callable:
    """A vectorised Python function over Arrow batches (pandas Series).

    ``libraries`` are Python files or archives shipped to the executors. A
    function that is not deterministic is neither repeated nor reordered.
    """
    if determinism not in DETERMINISM:
        raise RoutineError(f"determinism must be one of {', '.join(DETERMINISM)}")
    for path in libraries:
        spark.sparkContext.addPyFile(path)
    kind = returns if isinstance(returns, T.DataType) else _spark_name(returns)
    made = F.pandas_udf(function, kind)
    if determinism == "NOT_DETERMINISTIC":
        made = made.asNondeterministic()
    spark.udf.register(name, made)
    return made


@dataclass
class Procedure:
    """Steps that share named arguments, held in session variables.

    A step is SQL text, which reads arguments by name and assigns OUT ones with
    ``SET VAR``, or a Python function of (spark, values) returning a frame or
    None.
    """

    name: str
    args: Sequence[Argument]
    steps: Sequence[str | Callable[[SparkSession, Mapping[str, Any]], DataFrame | None]]
    out: dict[str, Any] = field(default_factory=dict)

    def call(self, spark: SparkSession, **values: Any) -> DataFrame | None:
        """Run the steps; returns the last frame, OUT values are in ``out``."""
        known = {a.name for a in self.args}
        unknown = set(values) - known
        missing = {a.name for a in self.args if a.mode != "OUT"} - set(values)
        if unknown or missing:
            raise RoutineError(
                f"procedure '{self.name}': "
                + "; ".join(
                    f"{what} {', '.join(sorted(names))}"
                    for what, names in (("unknown", unknown), ("missing", missing))
                    if names
                )
            )
        for a in self.args:
            spark.sql(f"DECLARE OR REPLACE VARIABLE {a.name} {a.spark_name()}")
            if a.name in values:
                spark.sql(f"SET VAR {a.name} = :v", args={"v": values[a.name]})
        result: DataFrame | None = None
        for step in self.steps:
            made = step(spark, values) if callable(step) else spark.sql(step)
            result = made if made is not None and made.columns else result
        names = [a.name for a in self.args if a.mode != "IN"]
        if names:
            row = spark.sql("SELECT " + ", ".join(names)).first()
            self.out = dict(zip(names, row, strict=True))
        return result


def create_procedure(name: str, args: Sequence[Argument], steps: Sequence[str | Callable]) -> Procedure:
    if not steps:
        raise RoutineError(f"procedure '{name}' has no steps")
    for step in steps:
        if isinstance(step, str):
            _check(name, step, args)
    return Procedure(name, args, steps)
