"""Table profiles, availability and probes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicesync.operators.distinct_bitmaps import distinct_counts, key_bitmaps
from slicesync.session import local_rows


def profile(
    df: DataFrame,
    moment: str,
    distinct: Mapping[str, str],
    flags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Count, first and last moment, distinct counts and flagged rows, in one row.

    Each distinct count is a scalar subquery that reads its own column: together
    with the other aggregates every row would be copied once for each of them.
    """
    totals = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(moment).alias("first_date"),
        F.max(moment).alias("last_date"),
        *[F.count_if(flag).alias(out) for out, flag in (flags or {}).items()],
    )
    return totals.select(
        "row_count", "first_date", "last_date",
        *[_distinct(df, column).scalar().alias(out) for out, column in distinct.items()],
        *(flags or {}),
    )


def _distinct(df: DataFrame, column: str) -> DataFrame:
    if isinstance(df.schema[column].dataType, T.IntegralType):
        counted = distinct_counts(key_bitmaps(df, [], column), [], "n")
        return counted.select(F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return df.select(column).distinct().agg(F.count(F.col(f"`{column}`")).alias("n"))


def period_availability(
    weights: DataFrame, eligibility: DataFrame, tenants: DataFrame, tenant: str
) -> DataFrame:
    """Per tenant: are weights there, and eligibility (which weights imply)?

    ``weights`` and ``eligibility`` are already limited to the period asked for.
    Each side is reduced to one row per tenant before they meet.
    """
    found = (
        weights.select(tenant, F.lit(True).alias("w"), F.lit(False).alias("e"))
        .unionByName(eligibility.select(tenant, F.lit(False).alias("w"), F.lit(True).alias("e")))
        .unionByName(tenants.select(tenant, F.lit(False).alias("w"), F.lit(False).alias("e")))
    )
    has_weights, has_eligibility = F.bool_or("w"), F.bool_or("e")
    return found.groupBy(tenant).agg(
        (has_weights | has_eligibility).alias("eligibility"), has_weights.alias("weights")
    )


def schema_rows(
    spark: SparkSession, schemas: Mapping[tuple[str, str], Sequence[str]]
) -> DataFrame:
    """(table, tenant, column) rows out of the column lists of many tables."""
    rows = [
        (table, tenant, column)
        for (table, tenant), columns in schemas.items()
        for column in columns
    ]
    return local_rows(spark, rows, "table_name string, tenant string, column_name string")


def filled_columns(tables: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """(table, tenant, column, values) rows: how many values each column really holds.

    One scan a table, and one row of counts a task; a column without values is no row.
    """
    parts = []
    for (table, tenant), df in tables.items():
        counted = df.agg(*[F.count(F.col(f"`{name}`")).alias(name) for name in df.columns])
        pairs = [
            F.struct(F.lit(name).alias("column_name"), F.col(f"`{name}`").alias("value_count"))
            for name in df.columns
        ]
        parts.append(counted.select(
            F.lit(table).alias("table_name"), F.lit(tenant).alias("tenant"),
            F.inline(F.array(*pairs)).alias("column_name", "value_count")))
    return reduce(DataFrame.unionByName, parts).where("value_count > 0")


def column_availability(rows: DataFrame, tenants: Sequence[str]) -> DataFrame:
    """Per table and column: in how many tenants of the table, and where it is missing.

    ``common`` columns exist in every tenant that has the table, the others are
    ``tenant-specific``.
    """
    per_column = rows.groupBy("table_name", "column_name").agg(
        F.sort_array(F.collect_set("tenant")).alias("_have")
    )
    # One row per column by now, so a table's window holds its columns only.
    of_table = Window.partitionBy("table_name")
    tenants_of_table = F.array_distinct(F.flatten(F.collect_set("_have").over(of_table)))
    known = F.array(*[F.lit(name) for name in tenants]).cast("array<string>")
    return per_column.withColumn("_tenants", tenants_of_table).select(
        "table_name",
        "column_name",
        F.when(F.size("_have") == F.size("_tenants"), "common").otherwise("tenant-specific")
        .alias("availability"),
        F.size("_have").alias("tenant_count"),
        F.array_join("_have", ",").alias("tenants_with_column"),
        F.array_join(F.sort_array(F.array_except("_tenants", "_have")), ",")
        .alias("tenants_without_column"),
        F.array_join(F.sort_array(F.array_except(known, "_tenants")), ",")
        .alias("tenants_without_table"),
    )


PROBE_SCHEMA = (
    "tenant string, query_name string, status string, column_count int, has_row boolean, "
    "error string"
)


def probe_queries(
    spark: SparkSession, queries: Mapping[tuple[str, str], Callable[[], DataFrame]]
) -> DataFrame:
    """Run each (tenant, query) for one row and report whether it works."""
    rows = []
    for (tenant, name), build in queries.items():
        try:
            df = build()
            rows.append((tenant, name, "OK", len(df.columns), not df.isEmpty(), None))
        except Exception as error:  # a broken query is a finding, not a failure
            rows.append((tenant, name, "FAIL", 0, False, str(error).split("\n")[0]))
    return local_rows(spark, rows, PROBE_SCHEMA)


def probe_summary(probes: DataFrame) -> DataFrame:
    return probes.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "OK").alias("ok"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
    )
