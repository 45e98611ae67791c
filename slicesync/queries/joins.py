"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from slicesync.operators import apply as A
from slicesync.operators.fingerprint import classify, level1_fingerprint
from slicesync.operators.permissions import PERMISSION_SCHEMA, decide
from slicesync.operators.slices import drop_slices, keep_slices
from slicesync.queries.registry import query
from slicesync.queries.shared import (
    CUSTOMERS_SQL,
    DIFF_CTE,
    PURCHASE_COLUMNS,
    QUEUE_CTE,
    current_purchases,
    customers_with_nation,
    money,
    previous_purchases,
    purchases,
    table,
)
from slicesync.session import local_rows

SLICE, NAMES = ["period", "l_suppkey"], ["level1_value", "level2_value"]


@query(
    "join1_fact_header",
    """
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, o_custkey, o_orderpriority
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
def join1(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    headers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return lines.join(headers, F.col("l_orderkey") == F.col("o_orderkey"), "inner").drop(
        "o_orderkey"
    )


def _bought_in(spark, sf_dir, region, out):
    """Quantity per product in one region, one row per product before any join."""
    owners = customers_with_nation(spark, sf_dir).where(F.col("r_name") == region)
    headers = table(spark, sf_dir, "orders").join(
        owners.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi"
    )
    lines = table(spark, sf_dir, "lineitem").join(
        headers.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return lines.groupBy(F.col("l_partkey").alias("product")).agg(
        F.sum(money("l_quantity")).cast("double").alias(out)
    )


@query(
    "join2_cross_tenant",
    f"""
    WITH t AS (
      SELECT r_name, l_partkey AS product, sum(l_quantity) AS quantity
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN {CUSTOMERS_SQL} ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT a.product, a.quantity AS quantity_asia, b.quantity AS quantity_europe
    FROM t a JOIN t b ON a.product = b.product WHERE a.r_name = 'ASIA' AND b.r_name = 'EUROPE'
    """,
)
def join2(spark, sf_dir):
    asia = _bought_in(spark, sf_dir, "ASIA", "quantity_asia")
    europe = _bought_in(spark, sf_dir, "EUROPE", "quantity_europe")
    return asia.join(europe, "product")


@query(
    "join3_keep_slices",
    f"""
    WITH {DIFF_CTE}
    SELECT {PURCHASE_COLUMNS} FROM cur
    WHERE (period, l_suppkey) IN (SELECT period, l_suppkey FROM slices)
    """,
)
def join3(spark, sf_dir):
    from slicesync.queries.sync import changed_slices

    return keep_slices(current_purchases(spark, sf_dir), changed_slices(spark, sf_dir), SLICE,
                       NAMES)


@query(
    "join4_slice_delete",
    f"""
    WITH {DIFF_CTE}
    SELECT {PURCHASE_COLUMNS} FROM prev
    WHERE (period, l_suppkey) NOT IN (SELECT period, l_suppkey FROM slices)
    """,
)
def join4(spark, sf_dir):
    from slicesync.queries.sync import changed_slices

    return drop_slices(previous_purchases(spark, sf_dir), changed_slices(spark, sf_dir), SLICE,
                       NAMES)


@query(
    "join5_fingerprint_compare",
    f"WITH {DIFF_CTE} SELECT period AS level1_value, status, row_count, stored_row_count FROM d1",
)
def join5(spark, sf_dir):
    now = level1_fingerprint(current_purchases(spark, sf_dir), "period")
    before = level1_fingerprint(previous_purchases(spark, sf_dir), "period")
    return classify(now, before, ["level1_value"]).select(
        "level1_value", "status",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("stored_row_count", F.lit(0)).alias("stored_row_count"),
    )


def price_corrections(spark, sf_dir):
    """New prices for the urgent orders; orders without a priority number lose theirs."""
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED')").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") * 2)
        .alias("o_totalprice"),
    )


UPDATED_SQL = """
    SELECT o_orderkey, o_custkey, o_orderstatus,
           CASE o_orderpriority WHEN '1-URGENT' THEN o_totalprice * 2
                WHEN '4-NOT SPECIFIED' THEN NULL ELSE o_totalprice END AS o_totalprice,
           o_orderdate, o_orderpriority{extra}
    FROM orders"""


@query(
    "join6_update_by_key",
    UPDATED_SQL.format(
        extra=", o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') AS was_matched"
    ),
)
def join6(spark, sf_dir):
    return A.update_rows(
        table(spark, sf_dir, "orders"), price_corrections(spark, sf_dir), ["o_orderkey"],
        matched="was_matched",
    )


@query(
    "join7_history_with_tags",
    f"""
    WITH {DIFF_CTE},
    h AS (SELECT period AS version, count(*) AS row_count FROM p GROUP BY 1),
    t AS (SELECT DISTINCT period AS version, l_returnflag || '-' || l_linestatus AS tag FROM p)
    SELECT h.version, h.row_count, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags
    FROM h LEFT JOIN t ON h.version = t.version GROUP BY 1, 2
    """,
)
def join7(spark, sf_dir):
    from slicesync.plans.tags import annotated_history

    rows = purchases(spark, sf_dir)
    history = rows.groupBy(F.col("period").alias("version")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    tags = rows.select(
        F.col("period").alias("version"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("tag"),
    ).distinct()
    return annotated_history(history, tags)


# A small permission table in the shape the operator expects.
GRANTS = [
    ("loader", "dbo.purchase", "read_write", 300),
    ("loader", "dbo.view", "write", None),
    ("loader", "dbo.click", "read", None),
    ("loader", "*", "write", 10),
    ("reader", "dbo.signup", "write", 50),
    ("reader", "*", "read", None),
]
GRANTS_SQL = f"""
g(user_name, table_name, access, cap) AS (VALUES {", ".join(
    str(grant).replace("None", "NULL") for grant in GRANTS)}),
r AS (SELECT *, CASE WHEN user_id < 75 THEN 'loader' ELSE 'reader' END AS user_name FROM q)"""


def grants(spark):
    return local_rows(spark, GRANTS, PERMISSION_SCHEMA)


def permission_requests(spark, sf_dir):
    """Each queued event asks to write its target table."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("ev-"), "event_id").alias("event_id"),
        F.when(F.col("user_id") < 75, "loader").otherwise("reader").alias("user_name"),
        F.concat(F.lit("dbo."), "event_type").alias("table_name"),
        F.floor("value").alias("delete_rows"),
    )


@query(
    "join8_permission_lookup",
    f"""
    WITH {QUEUE_CTE}, {GRANTS_SQL}
    SELECT event_id, coalesce(own.access, anywhere.access) IN ('write', 'read_write') AS granted
    FROM r LEFT JOIN g own ON own.table_name = r.target_table AND own.user_name = r.user_name
    LEFT JOIN g anywhere ON anywhere.table_name = '*' AND anywhere.user_name = r.user_name
    """,
)
def join8(spark, sf_dir):
    return decide(permission_requests(spark, sf_dir), grants(spark), F.lit("write")).select(
        "event_id", "granted"
    )
