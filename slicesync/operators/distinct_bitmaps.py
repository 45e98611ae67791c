"""Exact distinct counts that add up: bitmaps of keys, a few kilobytes a block of keys.

``count(DISTINCT)`` of a quarter cannot be had from those of its months. The
union of bitmaps can, so months are stored once and every longer period, or any
other union of groups, is counted from them. Keys are integers; blocks of 32,768
neighbouring keys share a row, so keys should be dense, as numbered keys are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def key_bitmaps(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One bitmap per combination of ``keys`` and block of the column; NULL counts as no key."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        raise ValueError(f"column {column!r} is no integer")
    value = F.col(f"`{column}`").cast("long")
    return (
        df.where(value.isNotNull())
        .select(*keys, F.bitmap_bucket_number(value).alias("block"), F.bitmap_bit_position(value).alias("_bit"))
        .groupBy(*keys, "block").agg(F.bitmap_construct_agg("_bit").alias("bitmap"))
    )


def united(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bitmaps of larger groups; ``keys`` are columns of ``bitmaps``."""
    return bitmaps.groupBy(*keys, "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def distinct_counts(bitmaps: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Distinct keys per combination of ``keys``; groups are united on the way."""
    blocks = united(bitmaps, keys)
    return blocks.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias(out))
