"""Scans and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from slicesync.functions.periods import run_sql, template_params
from slicesync.queries.registry import query
from slicesync.queries.shared import (
    AS_OF_ORDERS,
    CUSTOMERS_SQL,
    PURCHASES_CTE,
    customers_with_nation,
    money,
    purchases,
    region_names,
    table,
)
from slicesync.session import run_dir
from slicesync.sources import tables as S
from slicesync.sources.jdbc import spool
from slicesync.sources.versions import VersionedTable


def _common(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("code"), F.col("s_name").alias("description")
    )


def _tenant(spark, sf_dir):
    building = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return building.select(
        F.col("c_custkey").alias("code"), F.col("c_name").alias("description")
    )


@query(
    "src1_tenant_override",
    """
    SELECT c_custkey AS code, c_name AS description FROM customer
    WHERE c_mktsegment = 'BUILDING'
    UNION ALL
    SELECT s_suppkey, s_name FROM supplier
    WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    """,
)
def src1(spark, sf_dir):
    return S.override_rows(_common(spark, sf_dir), _tenant(spark, sf_dir), ["code"])


@query(
    "src2_entry_origin",
    """
    SELECT coalesce(s_suppkey, c_custkey) AS code,
           CASE WHEN c_custkey IS NULL THEN 'common' WHEN s_suppkey IS NULL
                THEN 'country-specific' ELSE 'override' END AS origin
    FROM supplier FULL OUTER JOIN
         (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON s_suppkey = c_custkey
    """,
)
def src2(spark, sf_dir):
    return S.entry_origin(_common(spark, sf_dir), _tenant(spark, sf_dir), ["code"])


@query(
    "src3_template_params",
    """
    SELECT (year(o_orderdate) * 100 + month(o_orderdate))::INT AS period, count(*) AS orders
    FROM orders
    WHERE o_orderdate >= DATE '1999-08-01' AND o_orderdate <= DATE '2001-08-02'
      AND year(o_orderdate) * 100 + month(o_orderdate) BETWEEN 199908 AND 200108
      AND year(o_orderdate) BETWEEN 1999 AND 2001
    GROUP BY 1
    """,
)
def src3(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("slicesync_src3_orders")
    return run_sql(
        spark,
        """
        SELECT year(o_orderdate) * 100 + month(o_orderdate) AS period, count(*) AS orders
        FROM slicesync_src3_orders
        WHERE o_orderdate >= cast(:start_date AS timestamp_ntz)
          AND o_orderdate <= cast(:end_date AS timestamp_ntz)
          AND year(o_orderdate) * 100 + month(o_orderdate) BETWEEN :start_period AND :end_period
          AND year(o_orderdate) BETWEEN :start_year AND :end_year
        GROUP BY 1
        """,
        template_params(AS_OF_ORDERS, 24),
    )


@query(
    "src6_parameterised_scan",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_totalprice >= 250000.5 AND o_orderdate >= DATE '2000-01-01'
    """,
)
def src6(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("slicesync_src6_orders")
    return run_sql(
        spark,
        "SELECT o_orderkey, o_custkey, o_totalprice FROM slicesync_src6_orders "
        "WHERE o_totalprice >= :lowest AND o_orderdate >= cast(:since AS timestamp_ntz)",
        {"lowest": 250000.5, "since": "2000-01-01"},
    )


@query(
    "src7_chunked_scan",
    """
    WITH t AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi,
                      (count(*) + 9999) // 10000 AS chunks FROM lineitem)
    SELECT (l_orderkey - lo) // ((hi - lo + chunks) // chunks) AS chunk, count(*) AS row_count,
           min(l_orderkey) AS min_key, max(l_orderkey) AS max_key
    FROM lineitem, t GROUP BY 1
    """,
)
def src7(spark, sf_dir):
    return S.chunk_counts(table(spark, sf_dir, "lineitem"), "l_orderkey", 10_000)


@query("src8_spool", "SELECT * FROM orders")
def src8(spark, sf_dir):
    return spool(table(spark, sf_dir, "orders"), run_dir(spark, "spool"), rows_per_file=5_000)


@query("src9_read_staged", "SELECT * FROM customer")
def src9(spark, sf_dir):
    staged = run_dir(spark, "staged")
    rows = table(spark, sf_dir, "customer")
    rows.withColumn(S.RESCUED_COLUMN, F.lit(None).cast("string")).write.parquet(staged)
    return S.read_staged(spark, staged)


@query("src10_read_lake_table", "SELECT * FROM part")
def src10(spark, sf_dir):
    lake = VersionedTable(spark, run_dir(spark, "lake"))
    lake.overwrite(table(spark, sf_dir, "part"))
    return lake.read()


@query(
    "src11_cross_database",
    """
    SELECT o_orderstatus, count(*) AS line_count,
           sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS total_value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
    """,
)
def src11(spark, sf_dir):
    databases = S.DatabaseMap(
        {
            "headers": lambda schema, name: table(spark, sf_dir, name),
            "details": lambda schema, name: spark.read.format("parquet").load(
                f"{sf_dir}/{name}.parquet"
            ),
        }
    )
    lines = databases.scan("details.dbo.lineitem").select("l_orderkey", "l_extendedprice")
    headers = databases.scan("headers.dbo.orders").select("o_orderkey", "o_orderstatus")
    return (
        lines.join(headers, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderstatus")
        .agg(
            F.count(F.lit(1)).alias("line_count"),
            F.sum(money("l_extendedprice")).cast("double").alias("total_value"),
        )
    )


def regional_servers(spark, sf_dir):
    """One reader per region, as if each were a server of its own."""
    everyone = customers_with_nation(spark, sf_dir)
    return {
        name: (lambda name=name: everyone.where(F.col("r_name") == name).select(
            "c_custkey", "c_name", "n_name", "c_acctbal"))
        for name in region_names(spark, sf_dir)
    }


@query(
    "src12_union_servers",
    f"SELECT c_custkey, c_name, n_name, c_acctbal, r_name AS server FROM {CUSTOMERS_SQL}",
)
def src12(spark, sf_dir):
    return S.union_servers(regional_servers(spark, sf_dir))


@query("src13_empty_relation", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def src13(spark, sf_dir):
    present = table(spark, sf_dir, "supplier")
    return present.unionByName(S.empty_relation(spark, present.schema))


@query(
    "src14_row_cap",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
    """,
)
def src14(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return S.row_cap(orders, 100, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query(
    "src15_pre_count",
    f"WITH {PURCHASES_CTE} SELECT count(*) AS row_count FROM p WHERE period >= 200001",
)
def src15(spark, sf_dir):
    recent = F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    return S.pre_count(purchases(spark, sf_dir).where(recent))


@query(
    "src16_column_metadata",
    "\nUNION ALL\n".join(
        f"SELECT {i} AS position, '{name}' AS column_name, '{kind}' AS data_type, true AS is_nullable, "
        f"count_if({name} IS NULL)::BIGINT AS null_count FROM orders"
        for i, (name, kind) in enumerate(
            [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
             ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
             ("o_orderpriority", "string")]
        )
    ),
)
def src16(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    described = S.column_metadata(orders)
    counted = S.column_null_counts(orders).select("column_name", "null_count")
    return described.join(counted, "column_name").select(
        "position", "column_name", "data_type", "is_nullable", "null_count"
    )


_LISTED = ("customer", "lineitem", "orders", "supplier")


@query(
    "src17_list_tables",
    "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, 'TEMPORARY' AS table_type, true AS table_exists, "
        f"count(*) AS row_count FROM {name}"
        for name in _LISTED
    ),
)
def src17(spark, sf_dir):
    combined = None
    for name in _LISTED:
        view = f"slicesync_src17_{name}"
        table(spark, sf_dir, name).createOrReplaceTempView(view)
        found = S.table_exists(spark, view)
        part = S.pre_count(spark.table(view)).select(
            F.lit(name).alias("table_name"), F.lit(found).alias("table_exists"), "row_count"
        )
        combined = part if combined is None else combined.unionByName(part)
    listed = S.list_tables(spark).where(F.col("table_name").startswith("slicesync_src17_")).select(
        F.replace("table_name", F.lit("slicesync_src17_"), F.lit("")).alias("table_name"), "table_type"
    )
    return listed.join(combined, "table_name").select(
        "table_name", "table_type", "table_exists", "row_count"
    )
