"""Keep, remove and restrict rows by slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicesync.session import local_rows

def _keys_of(df: DataFrame, slices: DataFrame, keys: Sequence[str], names: Sequence[str]):
    wanted = slices.select(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)]).distinct()
    condition = None
    for i, key in enumerate(keys):
        term = df[key].eqNullSafe(wanted[f"_k{i}"])
        condition = term if condition is None else condition & term
    return wanted, condition


def keep_slices(
    df: DataFrame, slices: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """Rows of ``df`` whose key is among ``slices`` (columns ``names``, else ``keys``)."""
    wanted, condition = _keys_of(df, slices, keys, names or keys)
    return df.join(wanted, condition, "left_semi")


def drop_slices(
    df: DataFrame, slices: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """Rows of ``df`` whose key is not among ``slices``."""
    wanted, condition = _keys_of(df, slices, keys, names or keys)
    return df.join(wanted, condition, "left_anti")


def restrict(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows with one of the given values, which may be given as text.

    A semi join on typed keys, however many they are; their range stands beside
    it as a bare filter, which prunes partitions and row groups.
    """
    kind = df.schema[column].dataType
    texts = [(None if value is None else str(value),) for value in values]
    wanted = local_rows(df.sparkSession, texts, "_value string")
    typed = wanted.select(F.col("_value").cast(kind).alias("_value"))
    low, high = typed.agg(F.min("_value"), F.max("_value")).first()
    condition = F.col(column).isNull() if (None,) in texts else F.lit(False)
    if low is not None:
        condition = condition | F.col(column).between(F.lit(low).cast(kind), F.lit(high).cast(kind))
    return keep_slices(df.where(condition), typed, [column], ["_value"])


def replace_slices(
    target: DataFrame, fresh: DataFrame, slices: DataFrame, keys: Sequence[str],
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Target without the given slices, plus fresh rows in the target's columns."""
    return drop_slices(target, slices, keys, names).unionByName(fresh.select(*target.columns))
