"""Clustering by several columns at once: rows along a Z-curve over quantile ranks.

Rows sorted by columns a, b lie together by a alone: a filter on b reads every file. Along
a Z-curve each file covers a box in all columns. Values are replaced by ranks
among approximate quantiles first, so that skewed and differently scaled columns count alike;
the bits of the ranks are interleaved, the first column's leading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Bits of a rank: 2 ** BITS quantiles a column.
BITS = 6
_PREFIX = 7


def measured(column: Column, kind: T.DataType) -> Column | None:
    """The value as a number in the same order; NULL stays, types without one have none.

    Strings count by their first bytes, which is enough to tell quantiles apart.
    """
    if isinstance(kind, T.BooleanType):
        return column.cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(column.cast("timestamp"), F.current_timezone())).cast("double")
    if kind == T.StringType():
        digits = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, _PREFIX)), 2 * _PREFIX, "0")
        return F.conv(digits, 16, 10).cast("double")
    return None


def bounds(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> dict[str, list[float]]:
    """Approximate quantiles of each column, from one pass; columns without an order are left out."""
    values = {c: v for c in columns if (v := measured(F.col(f"`{c}`"), df.schema[c].dataType)) is not None}
    if not values:
        return {}
    shares = [i / 2 ** bits for i in range(1, 2 ** bits)]
    row = df.agg(*[F.percentile_approx(v, shares, 10_000).alias(str(i)) for i, v in enumerate(values.values())]).first()
    return {c: sorted(set(row[str(i)] or ())) for i, c in enumerate(values)}


def rank(value: Column, ends: Sequence[float], bits: int = BITS) -> Column:
    """How many quantiles lie below the value, spread over all ranks; NULL goes with the first."""
    below = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: value > end)) if ends else F.lit(0)
    # Few distinct quantiles (few values, or one very common) are stretched over the leading bits.
    return F.coalesce(F.floor(below * (2 ** bits - 1) / max(1, len(ends))).cast("int"), F.lit(0))


def position(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> Column | None:
    """The place of a row along the curve, as a number; None if no column has an order."""
    found = bounds(df, columns, bits)
    if not found:
        return None
    values = F.struct(*[measured(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(found)])
    ranks = lambda v: F.struct(*[rank(v[f"v{i}"], ends, bits).alias(f"r{i}") for i, ends in enumerate(found.values())])

    def interleaved(r: Column) -> Column:
        place = F.lit(0).cast("long")
        for bit in range(bits):
            for i in range(len(found)):
                moved = F.shiftleft(F.shiftright(r[f"r{i}"], bit).bitwiseAND(1).cast("long"), bit * len(found) + len(found) - 1 - i)
                place = place.bitwiseOR(moved)
        return place

    # Bound to names, values are computed once for all bounds and ranks once for all bits.
    return F.element_at(F.transform(F.transform(F.array(values), ranks), interleaved), 1)
