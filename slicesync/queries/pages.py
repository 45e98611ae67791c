"""Windows, sorted pages and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from slicesync.operators import analytics as N
from slicesync.operators import paging as P
from slicesync.operators.events import pending
from slicesync.operators.fingerprint import classify, level1_fingerprint
from slicesync.queries.registry import query
from slicesync.queries.shared import (
    CUSTOMERS_SQL,
    DIFF_CTE,
    JOBS_CTE,
    PURCHASES_CTE,
    QUEUE_CTE,
    current_purchases,
    customers_with_nation,
    jobs,
    previous_purchases,
    purchases,
    queue_events,
    table,
)
from slicesync.sources.unify import concat_parts


@query(
    "win1_page_with_total",
    f"""
    WITH {JOBS_CTE}
    SELECT job_id, country, stage, created_at, count(*) OVER () AS total_count FROM j
    WHERE status = 'running' ORDER BY created_at DESC, job_id LIMIT 50
    """,
)
def win1(spark, sf_dir):
    running = jobs(spark, sf_dir).where("status = 'running'").select(
        "job_id", "country", "stage", "created_at"
    )
    return P.page_with_total(running, [F.desc("created_at"), "job_id"], 50)


@query(
    "win2_share",
    """
    SELECT l_returnflag, count(*) AS record_count,
           round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS percentage
    FROM lineitem GROUP BY 1
    """,
)
def win2(spark, sf_dir):
    return N.share_of_total(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query(
    "win3_running_total",
    f"""
    WITH {PURCHASES_CTE}, s AS (SELECT period, l_suppkey, count(*) AS row_count FROM p GROUP BY 1, 2)
    SELECT period, l_suppkey, row_count,
           sum(row_count) OVER (PARTITION BY period ORDER BY row_count DESC, l_suppkey
                                ROWS UNBOUNDED PRECEDING)::BIGINT AS rows_so_far FROM s
    """,
)
def win3(spark, sf_dir):
    slices = purchases(spark, sf_dir).groupBy("period", "l_suppkey").agg(
        F.count(F.lit(1)).alias("row_count")
    )
    total = N.running_total(
        slices, "row_count", [F.desc("row_count"), "l_suppkey"], ["period"]
    )
    return slices.withColumn("rows_so_far", total)


@query(
    "srt1_pending_queue",
    f"""
    WITH {QUEUE_CTE}
    SELECT event_id, priority, created_at FROM q WHERE status = 'pending'
    ORDER BY priority DESC, created_at, event_id LIMIT 100
    """,
)
def srt1(spark, sf_dir):
    return pending(queue_events(spark, sf_dir), 100).select("event_id", "priority", "created_at")


@query(
    "srt2_page",
    """
    SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100
    """,
)
def srt2(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return P.page(orders, [F.desc("o_orderdate"), "o_orderkey"], 50, 100)


@query(
    "srt2_deep_page",
    """
    SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice
    LIMIT 5 OFFSET (SELECT count(*) // 10 * 8 FROM lineitem)
    """,
)
def srt2_deep(spark, sf_dir):
    """A page behind 80 % of all rows: page 9,600 of five rows at 60,000 rows."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    behind = lines.count() // 10 * 8
    return P.page_at(lines, lines.columns, 5, behind, descending=["l_shipdate"], range_rows=10)


@query(
    "srt2_page_after",
    """
    SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
    WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'P')
       OR (o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'P')
           AND o_orderkey > (SELECT min_by(o_orderkey, (-epoch(o_orderdate), o_orderkey)) FROM orders
                             WHERE o_orderstatus = 'P'))
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 50
    """,
)
def srt2_after(spark, sf_dir):
    """The page behind the newest pending order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    order = ["o_orderdate", "o_orderkey"]
    newest = P.newest(orders.where("o_orderstatus = 'P'"), "o_orderdate", 1, "o_orderkey").first()
    found = P.page_after(orders, order, [newest[name] for name in order], 50, descending=["o_orderdate"])
    return found.drop("o_orderstatus")


@query(
    "srt3_newest_rows",
    """
    SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity
    FROM lineitem
    ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice LIMIT 10
    """,
)
def srt3(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"
    )
    return P.newest(lines, "l_shipdate", 10, "l_orderkey", "l_linenumber", "l_partkey",
                    "l_extendedprice")


@query(
    "srt4_history_slice",
    f"""
    WITH {PURCHASES_CTE}
    SELECT period AS version, count(*) AS row_count FROM p GROUP BY 1
    ORDER BY 1 DESC LIMIT 20 OFFSET 20
    """,
)
def srt4(spark, sf_dir):
    history = purchases(spark, sf_dir).groupBy(F.col("period").alias("version")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    return P.page(history, [F.desc("version")], 20, 20)


@query(
    "set1_union_all_label",
    """
    SELECT 'customer' AS origin, c_nationkey AS nation, c_acctbal AS balance FROM customer
    UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier
    """,
)
def set1(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("origin"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("origin"), F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("balance"),
    )
    return customers.unionByName(suppliers)


@query(
    "set2_unify_parts",
    """
    SELECT c_custkey AS code, NULL::TIMESTAMP AS seen_at, c_nationkey::BIGINT AS place FROM customer
    UNION ALL SELECT o_orderkey, o_orderdate, try_cast(o_orderpriority AS BIGINT) FROM orders
    UNION ALL SELECT s_suppkey, NULL, NULL FROM supplier
    """,
)
def set2(spark, sf_dir):
    """A column that is all NULL, one of another type, and one that is absent."""
    first = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("code"), F.lit(None).alias("seen_at"),
        F.col("c_nationkey").cast("long").alias("place"),
    )
    second = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("code"), F.col("o_orderdate").alias("seen_at"),
        F.col("o_orderpriority").alias("place"),
    )
    third = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("code"))
    return concat_parts([first, second, third])


@query(
    "set3_distinct",
    f"SELECT DISTINCT r_name, n_name, c_mktsegment FROM {CUSTOMERS_SQL}",
)
def set3(spark, sf_dir):
    return customers_with_nation(spark, sf_dir).select(
        "r_name", "n_name", "c_mktsegment"
    ).distinct()


@query(
    "set4_deleted_groups",
    f"WITH {DIFF_CTE} SELECT period AS level1_value, stored_row_count FROM d1 WHERE status = 'deleted'",
)
def set4(spark, sf_dir):
    now = level1_fingerprint(current_purchases(spark, sf_dir), "period")
    before = level1_fingerprint(previous_purchases(spark, sf_dir), "period")
    return classify(now, before, ["level1_value"]).where("status = 'deleted'").select(
        "level1_value", "stored_row_count"
    )
