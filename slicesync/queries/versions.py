"""Versions, tags, change feed and query probes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from slicesync.functions.periods import moment_literal, period_of
from slicesync.operators import quality as Q
from slicesync.plans.tags import TagRegistry, annotated_history, newest_versions, tag_text
from slicesync.queries.registry import query
from slicesync.queries.shared import CUSTOMERS_SQL, customers_with_nation, region_names, table
from slicesync.session import run_dir
from slicesync.sources.versions import VersionedTable, change_feed

FIRST_DAY, SECOND_DAY, THIRD_DAY = (datetime(2024, 1, day) for day in (1, 2, 3))


def three_versions(spark, sf_dir) -> VersionedTable:
    """Orders before 2001; those of 2001 added; then the open ones repriced, pending ones gone."""
    orders = table(spark, sf_dir, "orders")
    old = F.col("o_orderdate") < moment_literal(datetime(2001, 1, 1))
    versions = VersionedTable(spark, run_dir(spark, "versions"), partition_by="o_orderstatus")
    versions.overwrite(orders.where(old), committed_at=FIRST_DAY)
    versions.append(orders.where(~old), committed_at=SECOND_DAY)
    repriced = versions.read(parts=["O", "P"]).where("o_orderstatus = 'O'").withColumn(
        "o_totalprice", F.col("o_totalprice") * 2
    )
    versions.replace_parts(repriced, ["O", "P"], committed_at=THIRD_DAY)
    return versions


THIRD_SQL = """
    SELECT * REPLACE (CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END
                      AS o_totalprice) FROM orders WHERE o_orderstatus <> 'P'"""


@query(
    "ver1_create_tag",
    """
    SELECT 'orders' AS table_name, 3::BIGINT AS version, 'latest' AS tag, 'rows: ' || count(*) AS description
    FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'orders', 1, 'first', NULL
    """,
)
def ver1(spark, sf_dir):
    versions, tags = three_versions(spark, sf_dir), TagRegistry(spark, run_dir(spark, "tags"))
    tags.create("orders", versions, "first", version=1)
    tags.create("orders", versions, "latest", description=f"rows: {versions.read().count()}")
    return tags.read().select("table_name", "version", "tag", "description")


@query(
    "ver2_list_and_delete_tags",
    """
    SELECT 'orders' AS table_name, 3::BIGINT AS version, 'third' AS tag, (SELECT count(*) FROM orders) AS row_count
    UNION ALL SELECT 'orders', 1, 'first', (SELECT count(*) FROM orders)
    """,
)
def ver2(spark, sf_dir):
    versions, tags = three_versions(spark, sf_dir), TagRegistry(spark, run_dir(spark, "tags"))
    for number, name in enumerate(("first", "second", "third"), 1):
        tags.create("orders", versions, name, version=number, created_at=datetime(2024, 2, number))
    tags.delete("orders", "second")
    total = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n")).scalar()
    return tags.list("orders").select("table_name", "version", "tag", total.alias("row_count"))


@query(
    "ver3_tag_text",
    f"""
    SELECT o_orderkey, n_name || '-' || o_orderpriority || '-' || strftime(o_orderdate, '%Y-%m-%d')
             AS tag
    FROM orders JOIN {CUSTOMERS_SQL} ON o_custkey = c_custkey
    """,
)
def ver3(spark, sf_dir):
    owners = customers_with_nation(spark, sf_dir).select("c_custkey", "n_name")
    orders = table(spark, sf_dir, "orders").join(
        owners, F.col("o_custkey") == F.col("c_custkey")
    )
    day = F.col("o_orderdate").cast("date")
    return orders.select(
        "o_orderkey", tag_text(F.col("n_name"), F.col("o_orderpriority"), day).alias("tag")
    )


@query(
    "ver4_history",
    """
    SELECT 1::BIGINT AS version, TIMESTAMP '2024-01-01' AS committed_at, 'overwrite' AS operation,
           count(*) AS rows_written, '' AS tags FROM orders WHERE o_orderdate < '2001-01-01'
    UNION ALL SELECT 2, TIMESTAMP '2024-01-02', 'append', count(*), 'complete' FROM orders
      WHERE o_orderdate >= '2001-01-01'
    UNION ALL SELECT 3, TIMESTAMP '2024-01-03', 'replace', count(*), '' FROM orders
      WHERE o_orderstatus = 'O'
    """,
)
def ver4(spark, sf_dir):
    versions, tags = three_versions(spark, sf_dir), TagRegistry(spark, run_dir(spark, "tags"))
    tags.create("orders", versions, "complete", version=2)
    history = newest_versions(versions).select(
        "version", "committed_at", "operation", "rows_written"
    )
    return annotated_history(history, tags.of("orders"))


@query(
    "ver_many_tags",
    """
    WITH o AS (SELECT (year(o_orderdate) * 100 + month(o_orderdate))::BIGINT AS version, o_orderpriority,
                      day(o_orderdate) AS d FROM orders),
    t AS (SELECT DISTINCT version, o_orderpriority || '-' || lpad(d::VARCHAR, 2, '0') AS tag FROM o)
    SELECT version, count(*)::BIGINT AS tag_count, string_agg(tag, ',' ORDER BY tag) AS tags FROM t GROUP BY 1
    """,
)
def ver_many_tags(spark, sf_dir):
    """More tags than a page holds: one for each priority and day of a month."""
    orders = table(spark, sf_dir, "orders").select(
        period_of("o_orderdate").cast("long").alias("version"),
        F.concat_ws("-", "o_orderpriority", F.date_format("o_orderdate", "dd")).alias("tag"),
    ).distinct()
    registry = TagRegistry(spark, run_dir(spark, "many-tags"))
    none = F.lit(None).cast("string")
    registry.table.append(orders.select(
        F.lit("orders").alias("table_name"), "version", "tag", none.alias("description"),
        F.lit("system").alias("created_by"), moment_literal(FIRST_DAY).alias("created_at"),
        none.alias("job_id"),
    ), operation="tag")
    history = orders.groupBy("version").agg(F.count(F.lit(1)).alias("tag_count"))
    return annotated_history(history, registry.of("orders"))


@query(
    "ver5_read_as_of",
    f"""
    SELECT 'version 1' AS asked, count(*) AS row_count,
           sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total
    FROM orders WHERE o_orderdate < '2001-01-01'
    UNION ALL SELECT 'second day', count(*), sum(o_totalprice::DECIMAL(18,4))::DOUBLE FROM orders
    UNION ALL SELECT 'now', count(*), sum(o_totalprice::DECIMAL(18,4))::DOUBLE FROM ({THIRD_SQL})
    """,
)
def ver5(spark, sf_dir):
    versions = three_versions(spark, sf_dir)
    asked = {
        "version 1": versions.read(1),
        "second day": versions.read_at(datetime(2024, 1, 2, 12)),
        "now": versions.read(),
    }
    combined = None
    for label, rows in asked.items():
        part = rows.agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double").alias("total"),
        ).withColumn("asked", F.lit(label))
        combined = part if combined is None else combined.unionByName(part)
    return combined


@query(
    "ver6_change_feed",
    """
    SELECT 'insert' AS change_type, o_orderkey,
           CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE o_orderdate >= '2001-01-01' AND o_orderstatus <> 'P'
    UNION ALL SELECT 'delete', o_orderkey, o_totalprice FROM orders
    WHERE o_orderdate < '2001-01-01' AND o_orderstatus = 'P'
    UNION ALL SELECT 'update', o_orderkey, o_totalprice * 2 FROM orders
    WHERE o_orderdate < '2001-01-01' AND o_orderstatus = 'O'
    """,
)
def ver6(spark, sf_dir):
    feed = change_feed(three_versions(spark, sf_dir), 1, 3, ["o_orderkey"])
    return feed.select("change_type", "o_orderkey", "o_totalprice")


@query(
    "ver7_shared_slice",
    """
    SELECT o_orderkey, o_custkey, o_totalprice,
           (year(o_orderdate) * 100 + month(o_orderdate))::INT AS periodo
    FROM orders WHERE o_orderdate >= '2000-07-01'
    """,
)
def ver7(spark, sf_dir):
    shared = table(spark, sf_dir, "orders").where(
        F.col("o_orderdate") >= moment_literal(datetime(2000, 7, 1))
    )
    shared.select(
        "o_orderkey", "o_custkey", "o_totalprice", period_of("o_orderdate").alias("periodo")
    ).createOrReplaceTempView("slicesync_shared_purchases")
    return spark.table("slicesync_shared_purchases")


def _probes(spark, sf_dir):
    """Per region: its customers, its overdrawn customers, a query that is broken, and one whose
    column only a region has that has customers of some nation."""
    everyone = customers_with_nation(spark, sf_dir)
    queries = {}
    for name in region_names(spark, sf_dir):
        own = everyone.where(F.col("r_name") == name).select("c_custkey", "n_name", "c_acctbal")
        queries[(name, "customers")] = lambda own=own: own
        queries[(name, "overdrawn")] = lambda own=own: own.where("c_acctbal < -990")
        queries[(name, "broken")] = lambda own=own: own.select("no_such_column")
        queries[(name, "by nation")] = lambda own=own: own.groupBy().pivot("n_name").count().select("NATION_1")
    return Q.probe_queries(spark, queries)


@query(
    "val1_query_probe",
    f"""
    SELECT r_name AS tenant, 'customers' AS query_name, 'OK' AS status, 3 AS column_count,
           count(*) > 0 AS has_row FROM {CUSTOMERS_SQL} GROUP BY 1
    UNION ALL SELECT r_name, 'overdrawn', 'OK', 3, count_if(c_acctbal < -990) > 0
      FROM {CUSTOMERS_SQL} GROUP BY 1
    UNION ALL SELECT r_name, 'broken', 'FAIL', 0, false FROM region
    UNION ALL SELECT r_name, 'by nation', CASE WHEN bool_or(n_name = 'NATION_1') THEN 'OK' ELSE 'FAIL' END,
           bool_or(n_name = 'NATION_1')::INT, bool_or(n_name = 'NATION_1') FROM {CUSTOMERS_SQL} GROUP BY 1
    """,
)
def val1(spark, sf_dir):
    return _probes(spark, sf_dir).drop("error")


@query(
    "val2_probe_summary",
    f"""
    SELECT r_name AS tenant, 4::BIGINT AS total, 2 + bool_or(n_name = 'NATION_1')::BIGINT AS ok,
           2 - bool_or(n_name = 'NATION_1')::BIGINT AS failed FROM {CUSTOMERS_SQL} GROUP BY 1
    """,
)
def val2(spark, sf_dir):
    return Q.probe_summary(_probes(spark, sf_dir))
