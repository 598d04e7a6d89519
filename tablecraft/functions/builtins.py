"""Column functions and macros that model bodies use."""

from __future__ import annotations

import datetime as dt
import functools
import inspect
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablecraft.operators.layout import literal
from tablecraft.operators.ordered import fold_in_order

# Fixed value: what a NULL contributes to a surrogate key.
SURROGATE_KEY_NULL = "_dbt_utils_surrogate_key_null_"
DATE_PARTS = (
    "MICROSECOND", "MILLISECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR",
)


class MacroError(ValueError):
    """A macro called with the wrong arguments, or calling itself."""


def now(run_ts: dt.datetime | None = None) -> Column:
    """The run's clock: a fixed literal in a run, the wall clock outside one."""
    return literal(run_ts, T.TimestampType()) if run_ts is not None else F.current_timestamp()


def _part(name: str) -> str:
    unit = name.strip("'\" ").upper()
    if unit not in DATE_PARTS:
        raise ValueError(f"unknown date part '{name}'; use one of {', '.join(DATE_PARTS)}")
    return unit


def datediff(start: Column | str, end: Column | str, part: str) -> Column:
    """Whole ``part`` units from ``start`` to ``end`` (negative if end is earlier)."""
    return F.timestamp_diff(_part(part), start, end)


def dateadd(part: str, amount: int | Column, value: Column | str) -> Column:
    """``value`` moved by ``amount`` units."""
    quantity = F.lit(amount) if isinstance(amount, int) else amount
    return F.timestamp_add(_part(part), quantity, value)


def surrogate_key(*columns: Column | str, sep: str = "") -> Column:
    """Hex md5 of the columns cast to string.

    There is no separator by default, so ('ab','c') and ('a','bc') collide;
    pass ``sep`` to keep them apart.
    """
    if not columns:
        raise ValueError("a surrogate key needs at least one column")
    parts: list[Column] = []
    for c in columns:
        if parts and sep:
            parts.append(F.lit(sep))
        c = F.col(c) if isinstance(c, str) else c
        parts.append(F.coalesce(c.cast("string"), F.lit(SURROGATE_KEY_NULL)))
    return F.md5(F.concat(*parts).cast("binary"))


def listagg(measure: str, delimiter: str, order_by: str | None = None) -> Column:
    """Join values of a group, as an aggregate over SQL expressions.

    Without ``order_by`` the order is unspecified. The whole group passes
    through one aggregation buffer: for groups without a size bound use
    :func:`listagg_by`.
    """
    text = "'" + delimiter.replace("\\", "\\\\").replace("'", "\\'") + "'"
    call = f"listagg(CAST({measure} AS STRING), {text})"
    return F.expr(f"{call} WITHIN GROUP (ORDER BY {order_by})" if order_by else call)


def listagg_by(
    df: DataFrame,
    keys: Sequence[str],
    measure: Column | str,
    delimiter: str,
    order_by: Sequence[str] = (),
    name: str = "listagg",
    chunk: Column | None = None,
) -> DataFrame:
    """``listagg`` per key that splits hot groups over many tasks.

    Without ``order_by`` the order is unspecified.
    """
    value = (F.col(measure) if isinstance(measure, str) else measure).cast("string")
    return fold_in_order(df, keys, order_by, {name: (value, delimiter)}, chunk=chunk)


# -- macros --------------------------------------------------------------------
_active = threading.local()


def macro(function: Callable[..., Column]) -> Callable[..., Column]:
    """Turn a Python function over Columns into a named macro.

    Arguments are positional and counted; a macro may use other macros but
    must not reach itself.
    """
    arity = len(inspect.signature(function).parameters)

    @functools.wraps(function)
    def call(*args: Column | str) -> Column:
        stack: list[str] = getattr(_active, "stack", [])
        if len(args) != arity:
            raise MacroError(f"macro '{function.__name__}' takes {arity} arguments, got {len(args)}")
        if function.__name__ in stack:
            raise MacroError(f"macro '{function.__name__}' calls itself: {' -> '.join([*stack, function.__name__])}")
        _active.stack = [*stack, function.__name__]
        try:
            return function(*[F.col(a) if isinstance(a, str) else a for a in args])
        finally:
            _active.stack = stack

    return call


@macro
def cents_to_dollars(cents: Column) -> Column:
    """Cents as dollars, rounded to two places, as an exact decimal."""
    return F.round(cents.cast(T.DecimalType(20, 4)) * F.lit("0.01").cast(T.DecimalType(2, 2)), 2)
