"""Projections and scalar functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from slicesync.functions import columns as C
from slicesync.functions.hashing import row_hash
from slicesync.functions.periods import period_from_parts, period_of, shift_months
from slicesync.plans.extract import Extraction, panel_extraction
from slicesync.queries.registry import query
from slicesync.queries.shared import (
    AS_OF_EVENTS,
    AS_OF_ORDERS,
    CUSTOMERS_SQL,
    SCALE,
    customers_with_nation,
    hash_sql,
    money,
    table,
)


@query(
    "prj1_explicit_columns",
    "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders",
)
def prj1(spark, sf_dir):
    spec = Extraction("orders", columns=("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"))
    return spec.build(table(spark, sf_dir, "orders"), AS_OF_ORDERS)


@query("prj2_select_all", "SELECT * FROM orders")
def prj2(spark, sf_dir):
    return panel_extraction("origen").build(table(spark, sf_dir, "orders"), AS_OF_ORDERS)


@query(
    "prj3_alias",
    "SELECT s_suppkey AS idfornecedor, s_name AS descricao, s_nationkey AS idpais FROM supplier",
)
def prj3(spark, sf_dir):
    spec = Extraction(
        "fornecedor",
        columns={"idfornecedor": "s_suppkey", "descricao": "s_name", "idpais": "s_nationkey"},
    )
    return spec.build(table(spark, sf_dir, "supplier"), AS_OF_ORDERS)


@query(
    "prj4_period_of_date",
    "SELECT o_orderkey, (year(o_orderdate) * 100 + month(o_orderdate))::INT AS periodo FROM orders",
)
def prj4(spark, sf_dir):
    spec = Extraction(
        "orders", columns=("o_orderkey",),
        computed={"periodo": "year(o_orderdate) * 100 + month(o_orderdate)"},
    )
    return spec.build(table(spark, sf_dir, "orders"), AS_OF_ORDERS)


@query(
    "prj5_period_of_parts",
    """
    SELECT o_custkey, (year(o_orderdate) * 100 + month(o_orderdate))::INT AS periodo,
           count(*) AS orders FROM orders GROUP BY 1, 2
    """,
)
def prj5(spark, sf_dir):
    parts = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.year("o_orderdate").cast("string").alias("ano"),
        F.month("o_orderdate").cast("string").alias("messem"),
    )
    return parts.groupBy(
        "o_custkey", period_from_parts("ano", "messem").alias("periodo")
    ).agg(F.count(F.lit(1)).alias("orders"))


REGION_LABELS = {0: "Africa", 1: "Americas", 2: "Asia", 3: "Europe"}


@query(
    "prj6_code_label",
    f"""
    SELECT c_custkey, CASE WHEN n_regionkey = 0 THEN 'Africa' WHEN n_regionkey = 1
           THEN 'Americas' WHEN n_regionkey = 2 THEN 'Asia' WHEN n_regionkey = 3 THEN 'Europe'
           END AS region FROM {CUSTOMERS_SQL}
    """,
)
def prj6(spark, sf_dir):
    return customers_with_nation(spark, sf_dir).select(
        "c_custkey", C.code_label("n_regionkey", REGION_LABELS).alias("region")
    )


@query(
    "prj7_null_default",
    """
    SELECT c_custkey, coalesce(n, 0) AS orders
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
      ON c_custkey = o_custkey
    """,
)
def prj7(spark, sf_dir):
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n")
    )
    customers = table(spark, sf_dir, "customer")
    return customers.join(
        counted, customers["c_custkey"] == counted["o_custkey"], "left"
    ).select("c_custkey", C.default_zero("n").alias("orders"))


@query(
    "prj8_self_lookup",
    """
    SELECT DISTINCT p_brand AS region_id, p_brand AS region, p_brand AS descricao
    FROM part WHERE p_brand IS NOT NULL
    """,
)
def prj8(spark, sf_dir):
    return C.self_lookup(
        table(spark, sf_dir, "part"), "p_brand", ["region_id", "region", "descricao"]
    )


@query("prj9_lower_case_names", "SELECT * FROM supplier")
def prj9(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    return C.lower_case_names(suppliers.toDF(*[name.upper() for name in suppliers.columns]))


FACTORS = {
    "net": "cast(l_extendedprice * (1 - l_discount) as decimal(18,4))",
    "gross": "cast(l_extendedprice as decimal(18,4))",
}


@query(
    "prj10_expression_parameter",
    """
    SELECT l_returnflag,
           sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS factor
    FROM lineitem GROUP BY 1
    """,
)
def prj10(spark, sf_dir):
    factor = C.allowed_expression("net", FACTORS)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.sum(factor).cast("double").alias("factor")
    )


@query(
    "fn_scalar_functions",
    f"""
    SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m,
           strftime(o_orderdate, '%Y%m')::INT AS yyyymm,
           date_trunc('month', o_orderdate)::DATE AS month_start,
           (o_orderdate::DATE - INTERVAL 30 DAY)::DATE AS thirty_days_before,
           coalesce(nullif(o_orderstatus, 'P'), '0') AS status_or_zero,
           CASE WHEN o_totalprice >= 250000 THEN 'high' ELSE 'low' END AS price_class,
           round(o_totalprice / 1000)::BIGINT AS thousands,
           try_cast(split_part(o_orderpriority, '-', 1) AS BIGINT) AS priority_number,
           try_cast(o_orderpriority AS BIGINT) IS NULL AS bad_cast_is_null,
           trim('  ' || o_orderstatus || ' ') AS trimmed,
           {hash_sql('o_orderkey, o_custkey, o_orderstatus, o_totalprice')} AS checksum,
           json_extract_string('{{"k":"' || o_orderstatus || '"}}', '$.k') AS json_value
    FROM orders WHERE o_orderdate >= TIMESTAMP '1999-08-02'
    """,
)
def fn_scalar(spark, sf_dir):
    since = F.lit(shift_months(AS_OF_ORDERS, -24).isoformat(sep=" ")).cast("timestamp_ntz")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= since)
    return orders.select(
        "o_orderkey",
        F.year("o_orderdate").alias("y"),
        F.month("o_orderdate").alias("m"),
        F.date_format(F.col("o_orderdate").cast("date"), "yyyyMM").cast("int").alias("yyyymm"),
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month_start"),
        F.date_sub(F.col("o_orderdate").cast("date"), 30).alias("thirty_days_before"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("0")).alias("status_or_zero"),
        F.when(F.col("o_totalprice") >= 250000, "high").otherwise("low").alias("price_class"),
        F.round(F.col("o_totalprice") / 1000).cast("long").alias("thousands"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).try_cast("bigint")
        .alias("priority_number"),
        F.col("o_orderpriority").try_cast("bigint").isNull().alias("bad_cast_is_null"),
        F.trim(F.concat(F.lit("  "), "o_orderstatus", F.lit(" "))).alias("trimmed"),
        row_hash(orders, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], "md5", SCALE)
        .alias("checksum"),
        F.from_json(
            F.to_json(F.struct(F.col("o_orderstatus").alias("k"))), "struct<k:string>"
        )["k"].alias("json_value"),
    )


@query(
    "extract_panel_fact",
    """
    SELECT o_orderkey AS idato, o_custkey AS iddomicilio,
           (year(o_orderdate) * 100 + month(o_orderdate))::INT AS periodo,
           o_totalprice AS preco
    FROM orders WHERE year(o_orderdate) * 100 + month(o_orderdate) BETWEEN 199908 AND 200108
    """,
)
def extract_panel_fact(spark, sf_dir):
    """A fact table of the panel, read through its extraction."""
    source = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("idAto"),
        F.col("o_custkey").alias("idDomicilio"),
        period_of("o_orderdate").alias("periodo"),
        F.col("o_totalprice").alias("preco"),
    )
    return panel_extraction("j_atoscompra_new").build(source, AS_OF_ORDERS, 24)


@query(
    "extract_recent_days",
    """
    SELECT event_id AS idhato, ts AS data_criacao, money AS valor FROM (
      SELECT event_id, ts, value::DECIMAL(18,4)::DOUBLE AS money FROM events)
    WHERE ts >= TIMESTAMP '2024-04-15' - INTERVAL 90 DAY
    """,
)
def extract_recent_days(spark, sf_dir):
    source = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idHato"),
        F.col("ts").alias("data_criacao"),
        money("value").cast("double").alias("valor"),
    )
    return panel_extraction("hato_ruim_cabecalho").build(source, datetime(2024, 4, 15))
