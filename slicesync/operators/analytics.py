"""Panel analytics over purchases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicesync.operators.paging import page


def value_frequency(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, most frequent first."""
    return (
        df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.desc("row_count"), F.asc(column))
    )


def monthly_trend(
    df: DataFrame, moment: str, household: str, value: Column, months: int | None = 12
) -> DataFrame:
    """Transactions, distinct households and value per month, newest months first."""
    monthly = df.groupBy(F.trunc(F.col(moment).cast("date"), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_distinct(household).alias("panelists"),
        F.sum(value).alias("total_value"),
    )
    return page(monthly, [F.desc("month")], months) if months else monthly


def channel_summary(
    df: DataFrame, channel: str, trip: str, price: Column, quantity: Column
) -> DataFrame:
    return (
        df.groupBy(channel)
        .agg(
            F.count(F.lit(1)).alias("trip_count"),
            F.count_distinct(trip).alias("unique_trips"),
            F.avg(price).alias("avg_price"),
            F.sum(quantity).alias("total_quantity"),
        )
        .orderBy(F.desc("trip_count"), F.asc(channel))
    )


def period_totals(
    df: DataFrame, period: str, household: str, quantity: Column, value: Column
) -> DataFrame:
    return df.groupBy(period).agg(
        F.count_distinct(household).alias("households"),
        F.sum(quantity).alias("total_packs"),
        F.sum(value).alias("total_value"),
    )


def server_totals(df: DataFrame, server: str, country: str, value: Column) -> DataFrame:
    """One grouping over the union of all servers, not one per server."""
    return df.groupBy(server, country).agg(
        F.count(F.lit(1)).alias("purchase_count"), F.sum(value).alias("total_value")
    )


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their share in percent, two decimals.

    The total is taken over the grouped rows, one per value.
    """
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("record_count"))
    total = counted.agg(F.sum("record_count").alias("n")).scalar()
    return counted.select(
        column,
        "record_count",
        F.round(F.col("record_count") * 100.0 / total, 2).cast("double").alias("percentage"),
    )


def panel_kpis(
    purchases: DataFrame, weights: DataFrame, period: str, household: str, occasion: Sequence[str],
    value: Column,
) -> DataFrame:
    """Penetration and purchase frequency per period, weighted and raw.

    ``weights`` has one row (period, household, weight) per panel member.
    Purchases are first reduced to one row per household and period, so a hot
    household cannot weigh down the join. Purchases by households that have no
    weight in the period do not count.
    """
    per_household = purchases.groupBy(period, household).agg(
        F.count_distinct(*occasion).alias("occasions"), F.sum(value).alias("spent")
    )
    joined = weights.join(per_household, [period, household], "left")
    bought = F.col("occasions").isNotNull()
    weighted = joined.groupBy(period).agg(
        F.sum("weight").alias("hholds"),
        F.count(F.lit(1)).alias("hholds_raw"),
        F.sum(F.when(bought, F.col("weight"))).alias("buyers"),
        F.count_if(bought).alias("buyers_raw"),
        F.sum(F.col("weight") * F.col("occasions")).alias("occas"),
        F.sum("occasions").alias("occas_raw"),
        F.sum(F.col("weight") * F.col("spent")).alias("val_lc"),
    )
    return weighted.withColumns(
        {
            "penet": F.col("buyers") / F.col("hholds"),
            "penet_raw": F.col("buyers_raw") / F.col("hholds_raw"),
            "freq": F.try_divide(F.col("occas"), F.col("buyers")),
            "freq_raw": F.try_divide(F.col("occas_raw"), F.col("buyers_raw")),
        }
    )


def running_total(
    df: DataFrame, amount: str, order: Sequence[Column | str], within: Sequence[str]
) -> Column:
    """Running total of an aggregated relation inside each ``within`` group."""
    window = Window.partitionBy(*within).orderBy(*order)
    return F.sum(amount).over(window.rowsBetween(Window.unboundedPreceding, 0))

