"""A few intervals that hold many keys, so that a scan can prune by them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicesync.functions.periods import moment_literal
from slicesync.operators.slices import keep_slices

#: Cells a range of keys is counted in; about as many rows come to the driver.
CELLS = 4096


def ordinal(df: DataFrame, column: str) -> Column:
    """A long that grows with a column of integers, dates or timestamps (to the second)."""
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampNTZType):  # whatever the session's time zone
        seconds = F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)
        return F.unix_date(value.cast("date")).cast("long") * 86_400 + seconds
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(value)
    raise ValueError(f"column {column!r} is neither integer, date nor timestamp")


def occupied_cells(df: DataFrame, column: str, cells: int = CELLS) -> DataFrame:
    """Rows, lowest and highest value of each cell of equal width that has any.

    At most ``cells`` + 2 rows, by two scans of this column; NULLs are left out.
    """
    if cells < 1:
        raise ValueError("cells must be positive")
    place = df.select(F.col(f"`{column}`").alias("_value"), ordinal(df, column).alias("_place"))
    low, high = place.agg(F.min("_place"), F.max("_place")).first()
    width = 1 if low is None else -(-(high - low + 1) // cells)
    return (
        place.where("_place IS NOT NULL")
        .groupBy(F.expr(f"_place div {width}L").alias("cell"))
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min("_value").alias("low"), F.max("_value").alias("high"),
            F.min("_place").alias("first"), F.max("_place").alias("last"),
        )
    )


def cover(keys: DataFrame, column: str, at_most: int = 16, cells: int = CELLS) -> list[tuple]:
    """At most ``at_most`` closed intervals, in order, that hold every value but NULL.

    Cells that lie nearest are merged first. Intervals may hold other values too.
    """
    if at_most < 1:
        raise ValueError("at_most must be positive")
    found = sorted(occupied_cells(keys, column, cells).collect(), key=lambda row: row["first"])
    gaps = sorted(range(1, len(found)), key=lambda i: found[i - 1]["last"] - found[i]["first"])
    starts = sorted([0, *gaps[: at_most - 1]]) if found else []
    ends = [*(start - 1 for start in starts[1:]), len(found) - 1]
    return [(found[a]["low"], found[b]["high"]) for a, b in zip(starts, ends)]


def literal(value: object, kind: T.DataType) -> Column:
    return moment_literal(value) if isinstance(value, datetime) and isinstance(
        kind, T.TimestampNTZType) else F.lit(value).cast(kind)


def within(df: DataFrame, column: str, intervals: Sequence[tuple]) -> Column:
    """Whether a value lies in one of the intervals; the column stays bare for the scan."""
    kind, inside = df.schema[column].dataType, None
    for low, high in intervals:
        term = F.col(f"`{column}`").between(literal(low, kind), literal(high, kind))
        inside = term if inside is None else inside | term
    return F.lit(False) if inside is None else inside


def keep_keys(
    df: DataFrame, column: str, keys: DataFrame, name: str | None = None, at_most: int = 16
) -> DataFrame:
    """Rows whose ``column`` is among ``keys``, by intervals for the scan and then exactly.

    NULL is a key like any other. ``keys`` is read twice: give a staged table.
    """
    name = name or column
    inside = within(df, column, cover(keys, name, at_most))
    if not keys.where(F.col(f"`{name}`").isNull()).isEmpty():
        inside = inside | F.col(f"`{column}`").isNull()
    return keep_slices(df.where(inside), keys, [column], [name])
