"""Slice fingerprints and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicesync.functions.hashing import (
    finish_fingerprint,
    fingerprint_aggregates,
    row_hash,
)

MEASURES = ["row_count", "checksum_xor", "checksum_sum"]


def fingerprint(
    df: DataFrame,
    keys: Sequence[str] = (),
    columns: list[str] | None = None,
    method: str = "xxhash64",
    scale: int | None = None,
) -> DataFrame:
    """Count, XOR and sum of row hashes per combination of ``keys``.

    Partial aggregation leaves one row per slice and task for the shuffle, so
    a slice that holds most rows costs no more than any other.
    """
    # The hash is projected first: each aggregate would compute it again.
    hashed = df.select(*keys, row_hash(df, columns, method, scale).alias("_row_hash"))
    grouped = hashed.groupBy(*keys) if keys else hashed.groupBy()
    return finish_fingerprint(grouped.agg(*fingerprint_aggregates()))


def level1_fingerprint(df: DataFrame, level1: str, **options) -> DataFrame:
    return fingerprint(df.withColumn("level1_value", F.col(level1)), ["level1_value"],
                       options.pop("columns", None) or df.columns, **options)


def level2_fingerprint(df: DataFrame, level1: str, level2: str, **options) -> DataFrame:
    """All slices in one pass, however many level-1 values they span."""
    keyed = df.withColumns({"level1_value": F.col(level1), "level2_value": F.col(level2)})
    return fingerprint(keyed, ["level1_value", "level2_value"],
                       options.pop("columns", None) or df.columns, **options)


def window_fingerprint(df: DataFrame, **options) -> DataFrame:
    """One row for the whole relation; an empty one has count 0."""
    totals = fingerprint(df, **options)
    zero = {"checksum_xor": 0, "checksum_sum": 0}
    return totals.select(
        "row_count",
        *[
            F.coalesce(F.col(name), F.lit(value).cast(totals.schema[name].dataType)).alias(name)
            for name, value in zero.items()
        ],
    )


def roll_up(level2: DataFrame) -> DataFrame:
    """Level-1 fingerprints out of level-2 ones, without reading the rows again."""
    return level2.groupBy("level1_value").agg(
        F.sum("row_count").alias("row_count"),
        F.bit_xor("checksum_xor").alias("checksum_xor"),
        F.sum("checksum_sum").cast("decimal(38,0)").alias("checksum_sum"),
    )


def classify(current: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status of each slice: ``changed``, ``new``, ``deleted`` or ``unchanged``.

    The measures of both sides are kept, the stored ones prefixed ``stored_``.
    NULL is a slice like any other.
    """
    now, before = current.alias("now"), stored.alias("before")
    condition = None
    for key in keys:
        term = F.col(f"now.{key}").eqNullSafe(F.col(f"before.{key}"))
        condition = term if condition is None else condition & term
    same = None
    for name in MEASURES:
        term = F.col(f"now.{name}").eqNullSafe(F.col(f"before.{name}"))
        same = term if same is None else same & term
    status = (
        F.when(F.col("before.row_count").isNull(), "new")
        .when(F.col("now.row_count").isNull(), "deleted")
        .when(same, "unchanged")
        .otherwise("changed")
    )
    key_columns = [
        F.when(F.col("now.row_count").isNull(), F.col(f"before.{key}"))
        .otherwise(F.col(f"now.{key}"))
        .alias(key)
        for key in keys
    ]
    return now.join(before, condition, "full_outer").select(
        *key_columns,
        status.alias("status"),
        *[F.col(f"now.{name}").alias(name) for name in MEASURES],
        *[F.col(f"before.{name}").alias(f"stored_{name}") for name in MEASURES],
    )


def in_mutable_window(statuses: DataFrame, cutoff: int, key: str = "level1_value") -> DataFrame:
    """Flag slices that may be synchronised; a value that is no number always may."""
    number = F.col(key).cast("string").try_cast("bigint")
    return statuses.withColumn("in_window", F.coalesce(number >= cutoff, F.lit(True)))


def slices_to_sync(level1_status: DataFrame, level2_status: DataFrame) -> DataFrame:
    """Slices of changed or new level-1 values that must be replaced.

    Of a new level-1 value everything is read, whatever was stored below it.
    """
    outer = level1_status.where(F.col("status").isin("changed", "new")).select(
        F.col("level1_value").alias("_l1"), F.col("status").alias("_l1_status")
    )
    joined = level2_status.join(
        outer, level2_status["level1_value"].eqNullSafe(outer["_l1"]), "inner"
    )
    return joined.where(
        (F.col("_l1_status") == "new") | (F.col("status") != "unchanged")
    ).select("level1_value", "level2_value", "status", "row_count")


def sync_stats(level1_status: DataFrame) -> DataFrame:
    """One row: how many slices of each status, rows to read and rows skipped."""

    def count_of(status: str):
        return F.count_if(F.col("status") == status)

    def rows_of(*statuses: str):
        return F.coalesce(
            F.sum(F.when(F.col("status").isin(*statuses), F.col("row_count"))), F.lit(0)
        )

    return level1_status.agg(
        F.count("row_count").alias("total_level1_values"),
        count_of("changed").alias("changed_level1"),
        count_of("new").alias("new_level1"),
        count_of("deleted").alias("deleted_level1"),
        count_of("unchanged").alias("unchanged_level1"),
        rows_of("changed", "new").alias("rows_candidate"),
        rows_of("unchanged").alias("rows_skipped"),
    )


def largest_slices_cost(slices: DataFrame, largest: int, *tie_break: str) -> DataFrame:
    """Rows to read again if the n largest slices changed, for n = 1..``largest``.

    Only the top slices reach the running total, so its single task is bounded.
    """
    totals = slices.agg(F.sum("row_count").alias("n"))
    order = [F.desc("row_count"), *tie_break]
    top = slices.withColumn("_all", totals.scalar()).orderBy(*order).limit(largest)
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    read = F.sum("row_count").over(running)
    return top.select(
        F.row_number().over(Window.orderBy(*order)).alias("slices_changed"),
        *tie_break,
        "row_count",
        read.alias("rows_to_read"),
        F.round(100 * (1 - read / F.col("_all")), 1).alias("savings_pct"),
    )
