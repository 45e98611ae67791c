"""Apply an insert, update or delete to a target relation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ApplyError(ValueError):
    """An event that must not be applied as it stands."""


def check_keys(operation: str, primary_keys: Sequence[str]) -> None:
    if operation in ("UPDATE", "DELETE") and not primary_keys:
        raise ApplyError(f"primary keys are required for {operation}")


def check_columns(df: DataFrame, primary_keys: Sequence[str]) -> None:
    missing = [key for key in primary_keys if key not in df.columns]
    if missing:
        raise ApplyError(f"missing primary key columns: {', '.join(missing)}")


def check_delete_cap(rows: int, max_rows: int | None) -> None:
    if max_rows is not None and rows > max_rows:
        raise ApplyError(f"delete limit exceeded: {rows} > {max_rows}")


def split_target(name: str, default_schema: str = "dbo") -> tuple[str, str]:
    parts = name.split(".")
    if len(parts) > 2 or not all(parts):
        raise ApplyError(f"target must be table or schema.table: {name!r}")
    return (default_schema, parts[0]) if len(parts) == 1 else (parts[0], parts[1])


def split_source(name: str) -> tuple[str, str, str]:
    parts = name.split(".")
    if len(parts) != 3 or not all(parts):
        raise ApplyError(f"source must be catalog.schema.table: {name!r}")
    return parts[0], parts[1], parts[2]


def excess_key_rows(df: DataFrame, primary_keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key, over all keys that occur more than once."""
    return (
        df.groupBy(*primary_keys).agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("excess_rows"))
    )


def match_condition(
    primary_keys: Sequence[str], conditions: Mapping[str, object], columns: Sequence[str]
) -> Column:
    """Equality of every condition; keys without a condition do not restrict.

    No condition at all would mean every row and is refused.
    """
    named = [key for key in primary_keys if key in conditions]
    named += [name for name in conditions if name not in primary_keys]
    if not named:
        raise ApplyError("at least one condition is required")
    unknown = [name for name in named if name not in columns]
    if unknown:
        raise ApplyError(f"unknown columns in conditions: {', '.join(unknown)}")
    combined = None
    for name in named:
        term = F.col(name) == F.lit(conditions[name])
        combined = term if combined is None else combined & term
    return combined


def rows_to_delete(target: DataFrame, condition: Column) -> DataFrame:
    return target.where(condition).agg(F.count(F.lit(1)).alias("rows_to_delete"))


def insert_rows(target: DataFrame, source: DataFrame) -> DataFrame:
    """All rows of both; source columns by name, absent ones NULL."""
    unknown = [name for name in source.columns if name not in target.columns]
    if unknown:
        raise ApplyError(f"unknown columns: {', '.join(unknown)}")
    return target.unionByName(source, allowMissingColumns=True)


def update_rows(
    target: DataFrame, source: DataFrame, primary_keys: Sequence[str], matched: str | None = None
) -> DataFrame:
    """Set the source's other columns where the keys are equal.

    A NULL in the source is a value and overwrites. Source keys must be unique
    (see :func:`excess_key_rows`). ``matched`` names a flag column to keep.
    """
    check_columns(source, primary_keys)
    values = [name for name in source.columns if name not in primary_keys]
    unknown = [name for name in values if name not in target.columns]
    if unknown:
        raise ApplyError(f"unknown columns: {', '.join(unknown)}")
    changes = source.select(
        *[F.col(key).alias(f"_key_{key}") for key in primary_keys],
        *[F.col(name).alias(f"_new_{name}") for name in values],
        F.lit(True).alias("_matched"),
    )
    condition = None
    for key in primary_keys:
        term = target[key] == changes[f"_key_{key}"]
        condition = term if condition is None else condition & term
    columns = [
        F.when(F.col("_matched"), F.col(f"_new_{name}").cast(target.schema[name].dataType))
        .otherwise(F.col(name)).alias(name)
        if name in values and values
        else F.col(name)
        for name in target.columns
    ]
    if matched:
        columns.append(F.coalesce(F.col("_matched"), F.lit(False)).alias(matched))
    return target.join(changes, condition, "left").select(*columns)


def delete_rows(target: DataFrame, condition: Column) -> DataFrame:
    """Rows the condition does not hold for; where it is unknown the row stays."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def discrepancy(expected: Column, affected: Column) -> Column:
    """Expected minus affected rows; NULL when equal or when nothing was expected."""
    return F.when(expected.isNotNull() & (expected != affected), expected - affected)
