"""Filters. Each leaves the stored column bare, so that it reaches the scan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from slicesync.functions import periods as P
from slicesync.operators.apply import match_condition
from slicesync.operators.events import list_events
from slicesync.operators.slices import keep_slices
from slicesync.queries.registry import query
from slicesync.queries.shared import (
    AS_OF_EVENTS,
    AS_OF_ORDERS,
    AS_OF_PURCHASES,
    CUSTOMERS_SQL,
    DIFF_CTE,
    PURCHASES_CTE,
    QUEUE_CTE,
    customers_with_nation,
    purchases,
    queue_events,
    table,
)

LINES = ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"]
LINES_SQL = ", ".join(LINES)
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]
ORDERS_SQL = ", ".join(ORDERS)


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LINES)


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(*ORDERS)


@query(
    "flt1_period_range",
    f"WITH {PURCHASES_CTE} SELECT {LINES_SQL} FROM p WHERE period >= 200007 AND period <= 200106",
)
def flt1(spark, sf_dir):
    return _lines(spark, sf_dir).where(P.period_range_of("l_shipdate", 200007, 200106))


@query(
    "flt2_period_since_months",
    f"WITH {PURCHASES_CTE} SELECT {LINES_SQL} FROM p WHERE period >= 200105",
)
def flt2(spark, sf_dir):
    return _lines(spark, sf_dir).where(P.since_period_of("l_shipdate", AS_OF_PURCHASES, 6))


@query("flt3_year_range", f"SELECT {ORDERS_SQL} FROM orders WHERE year(o_orderdate) BETWEEN 1999 AND 2000")
def flt3(spark, sf_dir):
    return _orders(spark, sf_dir).where(P.in_years_of("o_orderdate", 1999, 2000))


@query("flt4_year_since_months", f"SELECT {ORDERS_SQL} FROM orders WHERE year(o_orderdate) >= 2000")
def flt4(spark, sf_dir):
    return _orders(spark, sf_dir).where(P.since_year_of("o_orderdate", AS_OF_ORDERS, 18))


@query(
    "flt5_timestamp_since_months",
    f"SELECT {ORDERS_SQL} FROM orders WHERE o_orderdate >= TIMESTAMP '2000-02-02 00:00:00'",
)
def flt5(spark, sf_dir):
    return _orders(spark, sf_dir).where(P.since_months("o_orderdate", AS_OF_ORDERS, 18))


@query(
    "flt6_timestamp_since_days",
    """
    SELECT event_id, ts, user_id FROM events
    WHERE ts >= TIMESTAMP '2024-01-21 12:30:00' - INTERVAL 7 DAY
    """,
)
def flt6(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return events.where(P.since_days("ts", datetime(2024, 1, 21, 12, 30), 7))


@query(
    "flt7_date_range",
    f"""
    SELECT {ORDERS_SQL} FROM orders
    WHERE o_orderdate >= DATE '1999-08-01' AND o_orderdate <= DATE '2001-08-02'
    """,
)
def flt7(spark, sf_dir):
    params = P.template_params(AS_OF_ORDERS, 24)
    return _orders(spark, sf_dir).where(
        P.between_moments("o_orderdate", params["start_date"], params["end_date"])
    )


@query(
    "flt8_flag_and_time",
    """
    SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate FROM lineitem
    WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '2000-11-05'
    """,
)
def flt8(spark, sf_dir):
    recent = P.since_months("l_shipdate", AS_OF_PURCHASES, 12)
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
        .where((F.col("l_returnflag") == "R") & recent)
    )


@query(
    "flt9_tenant_and_recency",
    f"""
    SELECT {ORDERS_SQL}, n_name FROM orders JOIN {CUSTOMERS_SQL} ON o_custkey = c_custkey
    WHERE n_name = 'NATION_7' AND o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY
    """,
)
def flt9(spark, sf_dir):
    owners = customers_with_nation(spark, sf_dir).where("n_name = 'NATION_7'")
    recent = _orders(spark, sf_dir).where(P.since_days("o_orderdate", AS_OF_ORDERS, 365))
    return recent.join(
        owners.select("c_custkey", "n_name"), F.col("o_custkey") == F.col("c_custkey")
    ).select(*ORDERS, "n_name")


@query(
    "flt10_not_null",
    "SELECT p_partkey, p_brand AS brand FROM part WHERE nullif(p_brand, 'Brand#1') IS NOT NULL",
)
def flt10(spark, sf_dir):
    """One brand stands for parts without any."""
    branded = table(spark, sf_dir, "part").select(
        "p_partkey", F.nullif("p_brand", F.lit("Brand#1")).alias("brand")
    )
    return branded.where(F.col("brand").isNotNull())


@query("flt11_year_of_date", f"SELECT {ORDERS_SQL} FROM orders WHERE year(o_orderdate) = 2000")
def flt11(spark, sf_dir):
    return _orders(spark, sf_dir).where(P.in_year_of("o_orderdate", 2000))


@query(
    "flt12_slice_predicate",
    f"""
    WITH {DIFF_CTE}
    SELECT p.period, p.l_suppkey, count(*) AS row_count FROM p
    WHERE (p.period, p.l_suppkey) IN (SELECT period, l_suppkey FROM slices WHERE status = 'changed')
    GROUP BY 1, 2
    """,
)
def flt12(spark, sf_dir):
    from slicesync.queries.sync import changed_slices

    slices = changed_slices(spark, sf_dir).where("status = 'changed'")
    kept = keep_slices(
        purchases(spark, sf_dir).select("period", "l_suppkey"), slices,
        ["period", "l_suppkey"], ["level1_value", "level2_value"],
    )
    return kept.groupBy("period", "l_suppkey").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "flt13_dynamic_equality",
    f"""
    SELECT {ORDERS_SQL}, o_orderpriority FROM orders
    WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
    """,
)
def flt13(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(*ORDERS, "o_orderpriority")
    conditions = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}
    return orders.where(match_condition(["o_orderpriority"], conditions, orders.columns))


@query(
    "flt14_optional_filters",
    f"""
    WITH {QUEUE_CTE}
    SELECT event_id, operation, status, priority, created_at FROM q
    WHERE status = 'pending' ORDER BY created_at DESC, event_id LIMIT 100
    """,
)
def flt14(spark, sf_dir):
    found = list_events(queue_events(spark, sf_dir), status="pending", operation=None)
    return found.select("event_id", "operation", "status", "priority", "created_at")


