"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from slicesync.functions.periods import period_of, since_days
from slicesync.operators import analytics as N
from slicesync.operators import apply as A
from slicesync.operators import distinct_bitmaps as B
from slicesync.operators import fingerprint as G
from slicesync.operators import jobs as J
from slicesync.operators import quality as Q
from slicesync.operators.audit import accesses_by_recipient
from slicesync.operators.events import event_counts
from slicesync.plans.incremental import watermark
from slicesync.queries.registry import query
from slicesync.queries.shared import (
    AS_OF_EVENTS,
    AS_OF_PURCHASES,
    CUSTOMERS_SQL,
    DIFF_CTE,
    JOBS_CTE,
    PURCHASES_CTE,
    SCALE,
    QUEUE_CTE,
    current_purchases,
    customers_with_nation,
    jobs,
    money,
    prints_sql,
    previous_purchases,
    purchases,
    region_names,
    queue_events,
    table,
)
from slicesync.queries.scans import regional_servers
from slicesync.session import stage
from slicesync.sources.tables import union_servers


def _texted(prints):
    return prints.withColumn("checksum_sum", F.col("checksum_sum").cast("string"))


@query(
    "agg1_level1_fingerprint",
    f"""
    WITH {PURCHASES_CTE}, f AS ({prints_sql('p', 'period')})
    SELECT period AS level1_value, row_count, checksum_xor, checksum_sum FROM f
    """,
)
def agg1(spark, sf_dir):
    return _texted(G.level1_fingerprint(purchases(spark, sf_dir), "period", method="md5", scale=SCALE))


@query(
    "agg2_level2_fingerprint",
    f"""
    WITH {PURCHASES_CTE}, f AS ({prints_sql('p', 'period, l_suppkey')})
    SELECT period AS level1_value, l_suppkey AS level2_value, row_count, checksum_xor,
           checksum_sum FROM f
    """,
)
def agg2(spark, sf_dir):
    rows = purchases(spark, sf_dir)
    return _texted(G.level2_fingerprint(rows, "period", "l_suppkey", method="md5", scale=SCALE))


@query(
    "agg3_window_fingerprint",
    f"""
    WITH {PURCHASES_CTE}, w AS (SELECT * FROM p WHERE l_shipdate >= TIMESTAMP '2001-08-07'),
    f AS ({prints_sql('w', '1')})
    SELECT row_count, checksum_xor, checksum_sum FROM f
    """.replace("GROUP BY 1", "").replace("SELECT 1, count", "SELECT count"),
)
def agg3(spark, sf_dir):
    window = purchases(spark, sf_dir).where(since_days("l_shipdate", AS_OF_PURCHASES, 90))
    return _texted(G.window_fingerprint(window, method="md5", scale=SCALE))


@query("agg4_watermark", "SELECT max(o_orderkey) AS max_key FROM orders")
def agg4(spark, sf_dir):
    return watermark(table(spark, sf_dir, "orders"), "o_orderkey")


@query(
    "agg5_duplicate_keys",
    """
    SELECT coalesce(sum(n - 1), 0)::BIGINT AS excess_rows FROM (
      SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1
    """,
)
def agg5(spark, sf_dir):
    return A.excess_key_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "agg6_rows_to_delete",
    """
    SELECT count(*) AS rows_to_delete FROM orders
    WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'
    """,
)
def agg6(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    conditions = {"o_orderstatus": "F", "o_orderpriority": "5-LOW"}
    return A.rows_to_delete(orders, A.match_condition([], conditions, orders.columns))


@query(
    "agg7_table_profile",
    """
    SELECT count(*) AS row_count, min(l_shipdate) AS first_date, max(l_shipdate) AS last_date,
           count(DISTINCT l_suppkey) AS unique_panelists,
           count(DISTINCT l_orderkey) AS unique_transactions FROM lineitem
    """,
)
def agg7(spark, sf_dir):
    return Q.profile(
        table(spark, sf_dir, "lineitem"), "l_shipdate",
        {"unique_panelists": "l_suppkey", "unique_transactions": "l_orderkey"},
    )


@query(
    "agg7_distinct_by_bitmaps",
    f"""
    WITH {PURCHASES_CTE},
    d AS (
      SELECT 'month' AS span, period AS value, l_orderkey FROM p
      UNION ALL SELECT 'quarter', period // 100 * 10 + (period % 100 + 2) // 3, l_orderkey FROM p
      UNION ALL SELECT 'year', period // 100, l_orderkey FROM p
      UNION ALL SELECT 'all', NULL, l_orderkey FROM p
    )
    SELECT span, value::INT AS value, count(DISTINCT l_orderkey) AS orders FROM d GROUP BY 1, 2
    """,
)
def agg7_bitmaps(spark, sf_dir):
    """Distinct orders per month, quarter and year, and of all: the longer ones from stored months."""
    rows = purchases(spark, sf_dir).select("period", "l_orderkey")
    months = stage(B.key_bitmaps(rows, ["period"], "l_orderkey"), "bitmaps")
    quarter = F.expr("period div 100 * 10 + (period % 100 + 2) div 3")
    spans = {"month": F.col("period"), "quarter": quarter, "year": F.expr("period div 100"),
             "all": F.lit(None)}
    combined = None
    for span, value in spans.items():
        part = B.distinct_counts(months.withColumn("value", value.cast("int")), ["value"], "orders")
        part = part.withColumn("span", F.lit(span))
        combined = part if combined is None else combined.unionByName(part)
    return combined


@query(
    "agg8_profile_with_flags",
    """
    SELECT count(*) AS row_count, min(l_shipdate) AS first_date, max(l_shipdate) AS last_date,
           count(DISTINCT l_orderkey) AS unique_trips,
           count(DISTINCT l_linestatus) AS unique_forms,
           count_if(l_returnflag = 'R')::BIGINT AS duplicate_count FROM lineitem
    """,
)
def agg8(spark, sf_dir):
    return Q.profile(
        table(spark, sf_dir, "lineitem"), "l_shipdate",
        {"unique_trips": "l_orderkey", "unique_forms": "l_linestatus"},
        {"duplicate_count": F.col("l_returnflag") == "R"},
    )


@query(
    "agg9_monthly_trend",
    """
    SELECT date_trunc('month', l_shipdate)::DATE AS month, count(*) AS transactions,
           count(DISTINCT o_custkey) AS panelists,
           sum((l_quantity * l_extendedprice)::DECIMAL(18,4))::DOUBLE AS total_value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    GROUP BY 1 ORDER BY 1 DESC LIMIT 12
    """,
)
def agg9(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_shipdate", "l_quantity", "l_extendedprice"
    )
    headers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(headers, F.col("l_orderkey") == F.col("o_orderkey"))
    value = money(F.col("l_quantity") * F.col("l_extendedprice"))
    trend = N.monthly_trend(rows, "l_shipdate", "o_custkey", value)
    return trend.withColumn("total_value", F.col("total_value").cast("double"))


@query(
    "agg10_channel_summary",
    """
    SELECT o_orderpriority, count(*) AS trip_count, count(DISTINCT o_custkey) AS unique_trips,
           round(avg(o_totalprice), 4) AS avg_price,
           sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total_quantity
    FROM orders GROUP BY 1
    """,
)
def agg10(spark, sf_dir):
    summary = N.channel_summary(
        table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey", F.col("o_totalprice"),
        money("o_totalprice"),
    )
    return summary.withColumns(
        {"avg_price": F.round("avg_price", 4),
         "total_quantity": F.col("total_quantity").cast("double")}
    )


@query(
    "agg11_period_totals",
    f"""
    WITH {PURCHASES_CTE}
    SELECT period, count(DISTINCT o_custkey) AS households,
           sum(l_quantity::DECIMAL(18,4))::DOUBLE AS total_packs,
           sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS total_value
    FROM p JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
    """,
)
def agg11(spark, sf_dir):
    lines = purchases(spark, sf_dir).select(
        "l_orderkey", "period", "l_quantity", "l_extendedprice"
    )
    headers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(headers, F.col("l_orderkey") == F.col("o_orderkey"))
    totals = N.period_totals(
        rows, "period", "o_custkey", money("l_quantity"), money("l_extendedprice")
    )
    return totals.withColumns(
        {name: F.col(name).cast("double") for name in ("total_packs", "total_value")}
    )


@query(
    "agg12_server_totals",
    f"""
    SELECT r_name AS server, n_name, count(*) AS purchase_count,
           sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total_value
    FROM orders JOIN {CUSTOMERS_SQL} ON o_custkey = c_custkey GROUP BY 1, 2
    """,
)
def agg12(spark, sf_dir):
    everyone = union_servers(regional_servers(spark, sf_dir)).select(
        "server", "n_name", "c_custkey"
    )
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(
        everyone, F.col("o_custkey") == F.col("c_custkey")
    )
    totals = N.server_totals(rows, "server", "n_name", money("o_totalprice"))
    return totals.withColumn("total_value", F.col("total_value").cast("double"))


@query(
    "agg13_value_frequency",
    "SELECT l_suppkey, count(*) AS row_count FROM lineitem GROUP BY 1",
)
def agg13(spark, sf_dir):
    return N.value_frequency(table(spark, sf_dir, "lineitem"), "l_suppkey")


@query(
    "agg14_event_counts",
    f"""
    WITH {QUEUE_CTE}
    SELECT 'total' AS scope, 'all' AS scope_value, count(*) AS event_count FROM q
    UNION ALL SELECT 'status', status, count(*) FROM q GROUP BY status
    UNION ALL SELECT 'operation', operation, count(*) FROM q GROUP BY operation
    """,
)
def agg14(spark, sf_dir):
    return event_counts(queue_events(spark, sf_dir))


@query(
    "agg15_latest_completed_job",
    f"""
    WITH {JOBS_CTE}
    SELECT country, job_id, stage, completed_at FROM j WHERE status = 'completed'
    QUALIFY row_number() OVER (PARTITION BY country ORDER BY completed_at DESC, job_id DESC) = 1
    """,
)
def agg15(spark, sf_dir):
    completed = jobs(spark, sf_dir).where("status = 'completed'")
    return J.latest_per(
        completed, "country", "completed_at", ["job_id", "stage", "completed_at"], "job_id"
    )


@query(
    "agg16_latest_finalized_run",
    f"""
    WITH {JOBS_CTE}
    SELECT country, job_id AS run_id, period, completed_at FROM (
      SELECT *, (year(created_at) * 100 + month(created_at))::INT AS period FROM j)
    WHERE status = 'completed' AND stage = '1-URGENT'
    QUALIFY row_number() OVER (PARTITION BY country ORDER BY completed_at DESC, job_id DESC) = 1
    """,
)
def agg16(spark, sf_dir):
    runs = jobs(spark, sf_dir).where("status = 'completed' AND stage = '1-URGENT'").select(
        "country", F.col("job_id").alias("run_id"), period_of("created_at").alias("period"),
        "completed_at",
    )
    return J.latest_per(runs, "country", "completed_at", ["run_id", "period", "completed_at"],
                        "run_id")


def _json_results(spark, sf_dir):
    """Each job with the results of its two queries as the JSON text a job keeps."""
    rows = table(spark, sf_dir, "orders")
    header = F.struct(
        F.lit("header").alias("query_name"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"),
        F.col("o_custkey").alias("rows_extracted"),
        F.lit(None).cast("string").alias("error"),
    )
    lines = F.struct(
        F.lit("lines").alias("query_name"),
        F.when(F.col("o_totalprice") >= 400000, "failed").otherwise("completed").alias("status"),
        F.floor("o_totalprice").alias("rows_extracted"),
        F.lit(None).cast("string").alias("error"),
    )
    return rows.select(
        F.col("o_orderkey").alias("job_id"), F.to_json(F.array(header, lines)).alias("results")
    )


ROLLUP_SQL = """
r AS (
  SELECT o_orderkey AS job_id,
         (o_orderstatus <> 'P')::BIGINT + (o_totalprice < 400000)::BIGINT AS queries_completed,
         (o_orderstatus = 'P')::BIGINT + (o_totalprice >= 400000)::BIGINT AS queries_failed,
         (o_custkey + floor(o_totalprice))::BIGINT AS total_rows
  FROM orders
)"""


@query(
    "agg17_job_rollup",
    f"WITH {ROLLUP_SQL} SELECT job_id, queries_completed, queries_failed, total_rows FROM r",
)
def agg17(spark, sf_dir):
    return J.job_rollup(J.explode_results(_json_results(spark, sf_dir)), ["job_id"]).drop("status")


@query(
    "agg18_overall_status",
    f"""
    WITH {ROLLUP_SQL}
    SELECT CASE WHEN queries_failed > 0 AND queries_completed = 0 THEN 'failed'
                ELSE 'completed' END AS status, count(*) AS jobs, sum(total_rows)::BIGINT AS total_rows
    FROM r GROUP BY 1
    """,
)
def agg18(spark, sf_dir):
    rolled = J.job_rollup(J.explode_results(_json_results(spark, sf_dir)), ["job_id"])
    return rolled.groupBy("status").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("total_rows").alias("total_rows")
    )


@query(
    "agg19_period_availability",
    f"""
    WITH o AS (SELECT n_name, o_orderpriority FROM orders JOIN {CUSTOMERS_SQL} ON o_custkey = c_custkey
               WHERE o_orderdate >= DATE '2001-07-30' AND o_orderdate < DATE '2001-08-01')
    SELECT n_name, bool_or(coalesce(o_orderpriority = '1-URGENT', false)) AS weights,
           bool_or(coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false)) AS eligibility
    FROM nation LEFT JOIN o USING (n_name) GROUP BY 1
    """,
)
def agg19(spark, sf_dir):
    owners = customers_with_nation(spark, sf_dir).select("c_custkey", "n_name")
    in_period = F.col("o_orderdate").between(
        F.lit("2001-07-30").cast("timestamp_ntz"), F.lit("2001-07-31").cast("timestamp_ntz")
    )
    rows = table(spark, sf_dir, "orders").where(in_period).join(
        owners, F.col("o_custkey") == F.col("c_custkey")
    )
    return Q.period_availability(
        rows.where("o_orderpriority = '1-URGENT'"),
        rows.where("o_orderpriority = '2-HIGH'"),
        table(spark, sf_dir, "nation"), "n_name",
    )


@query(
    "agg20_column_availability",
    f"""
    WITH t AS (SELECT DISTINCT p_type AS table_name, r_name AS tenant, p_brand AS column_name
               FROM part JOIN lineitem ON l_partkey = p_partkey
               JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
               JOIN region ON n_regionkey = r_regionkey),
    b AS (SELECT table_name, count(DISTINCT tenant) AS tenants FROM t GROUP BY 1),
    c AS (SELECT table_name, column_name, count(*) AS n,
                 string_agg(tenant, ',' ORDER BY tenant) AS tenants_with_column FROM t GROUP BY 1, 2)
    SELECT c.table_name, column_name, n::INT AS tenant_count, tenants_with_column,
           CASE WHEN n = b.tenants THEN 'common' ELSE 'tenant-specific' END AS availability,
           coalesce((SELECT string_agg(tenant, ',' ORDER BY tenant)
                     FROM (SELECT DISTINCT tenant FROM t t2 WHERE t2.table_name = c.table_name
                           AND tenant NOT IN (SELECT tenant FROM t t3
                                              WHERE t3.table_name = c.table_name
                                              AND t3.column_name = c.column_name))), '')
             AS tenants_without_column,
           coalesce((SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region WHERE r_name NOT IN (
                       SELECT tenant FROM t t4 WHERE t4.table_name = c.table_name)), '')
             AS tenants_without_table
    FROM c JOIN b ON c.table_name = b.table_name
    """,
)
def agg20(spark, sf_dir):
    """Types stand for tables and brands for columns: which tenants have which."""
    places = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "r_name")
    )
    rows = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("p_type").alias("table_name"), F.col("r_name").alias("tenant"),
            F.col("p_brand").alias("column_name"),
        )
    )
    return Q.column_availability(rows, region_names(spark, sf_dir))


_PLACES = {
    "customer": {"nationkey": "c_nationkey", "name": "c_name", "overdrawn": "nullif(greatest(c_acctbal, 0), c_acctbal)",
                 "unused": "nullif(c_custkey, c_custkey)"},
    "nation": {"nationkey": "n_nationkey", "name": "n_name", "regionkey": "n_regionkey"},
    "region": {"regionkey": "r_regionkey", "name": "r_name"},
}


@query(
    "agg20_schema_availability",
    "WITH v AS ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS tenant, '{column}' AS column_name, count({value}) AS n FROM {name}"
        for name, columns in _PLACES.items() for column, value in columns.items())
    + """),
    f AS (SELECT * FROM v WHERE n > 0)
    SELECT 'place' AS table_name, column_name, sum(n)::BIGINT AS value_count,
           CASE WHEN count(*) = 3 THEN 'common' ELSE 'tenant-specific' END AS availability,
           count(*)::INT AS tenant_count, string_agg(tenant, ',' ORDER BY tenant) AS tenants_with_column,
           coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM (VALUES ('customer'), ('nation'), ('region')) w(t)
                     WHERE t NOT IN (SELECT tenant FROM f f2 WHERE f2.column_name = f.column_name)), '')
             AS tenants_without_column,
           'supplier' AS tenants_without_table
    FROM f GROUP BY column_name""",
)
def agg20_schema(spark, sf_dir):
    """Columns that hold values in the tables of three tenants; a fourth has no such table."""
    tables = {
        ("place", name): table(spark, sf_dir, name).selectExpr(*[f"{v} AS {c}" for c, v in columns.items()])
        for name, columns in _PLACES.items()
    }
    filled = stage(Q.filled_columns(tables), "filled")
    values = filled.groupBy("column_name").agg(F.sum("value_count").alias("value_count"))
    return Q.column_availability(filled, [*_PLACES, "supplier"]).join(values, "column_name")


@query(
    "agg21_diff_savings",
    f"""
    WITH {PURCHASES_CTE},
    s AS (SELECT period, l_suppkey, count(*) AS row_count FROM p GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER w AS slices_changed,
                 sum(row_count) OVER (w ROWS UNBOUNDED PRECEDING) AS rows_to_read,
                 sum(row_count) OVER () AS n
          FROM s WINDOW w AS (ORDER BY row_count DESC, period, l_suppkey))
    SELECT slices_changed::INT AS slices_changed, period, l_suppkey, row_count, rows_to_read::BIGINT AS rows_to_read,
           round(100 * (1 - rows_to_read / n), 1)::DOUBLE AS savings_pct
    FROM o WHERE slices_changed <= 100
    """,
)
def agg21(spark, sf_dir):
    slices = purchases(spark, sf_dir).groupBy("period", "l_suppkey").agg(
        F.count(F.lit(1)).alias("row_count")
    )
    return G.largest_slices_cost(slices, 100, "period", "l_suppkey")


@query(
    "agg22_step_progress",
    f"""
    WITH {JOBS_CTE}
    SELECT country, count(*) AS steps_total, count_if(status = 'completed')::BIGINT AS steps_completed,
           round(count_if(status = 'completed') * 100.0 / count(*), 1)::DOUBLE AS progress_pct
    FROM j GROUP BY 1
    """,
)
def agg22(spark, sf_dir):
    return J.progress(jobs(spark, sf_dir), ["country"])


@query(
    "agg23_recipient_accesses",
    """
    SELECT 'user-' || user_id AS recipient, event_type AS table_name, count(*) AS query_count
    FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1, 2
    """,
)
def agg23(spark, sf_dir):
    from slicesync.queries.queue import audit_events

    return accesses_by_recipient(audit_events(spark, sf_dir), AS_OF_EVENTS, 7)


def _panel_weights(spark, sf_dir):
    """A customer is a panel member in each period with an order or a shipment of one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", period_of("o_orderdate").alias("period"))
    shipped = table(spark, sf_dir, "lineitem").select("l_orderkey", period_of("l_shipdate").alias("period"))
    seen = orders.select("period", "o_custkey").unionByName(
        shipped.join(orders.drop("period"), F.col("l_orderkey") == F.col("o_orderkey")).select("period", "o_custkey"))
    members = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("household"),
        (F.lit(1) + F.floor(F.abs("c_acctbal") / 1000)).cast("long").alias("weight"),
    )
    return seen.distinct().join(members, F.col("o_custkey") == F.col("household")).select(
        "period", "household", "weight"
    )


@query(
    "agg24_panel_kpis",
    """
    WITH seen AS (
      SELECT (year(o_orderdate) * 100 + month(o_orderdate))::INT AS period, o_custkey FROM orders
      UNION SELECT (year(l_shipdate) * 100 + month(l_shipdate))::INT, o_custkey
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    w AS (SELECT period, c_custkey AS household, (1 + floor(abs(c_acctbal) / 1000))::BIGINT AS weight
          FROM seen JOIN customer ON o_custkey = c_custkey),
    b AS (SELECT (year(o_orderdate) * 100 + month(o_orderdate))::INT AS period, o_custkey AS household,
                 count(DISTINCT o_orderkey) AS occasions,
                 sum(o_totalprice::DECIMAL(18,4)) AS spent FROM orders GROUP BY 1, 2),
    k AS (SELECT period, sum(weight) AS hholds, count(*) AS hholds_raw,
                 sum(CASE WHEN occasions IS NOT NULL THEN weight END) AS buyers,
                 count(occasions) AS buyers_raw, sum(weight * occasions) AS occas,
                 sum(occasions) AS occas_raw, sum(weight * spent)::DOUBLE AS val_lc
          FROM w LEFT JOIN b USING (period, household) GROUP BY 1)
    SELECT period, hholds::BIGINT AS hholds, hholds_raw, buyers::BIGINT AS buyers, buyers_raw,
           occas::BIGINT AS occas, occas_raw::BIGINT AS occas_raw, val_lc,
           buyers::DOUBLE / hholds::DOUBLE AS penet, buyers_raw::DOUBLE / hholds_raw AS penet_raw,
           occas::DOUBLE / buyers::DOUBLE AS freq, occas_raw::DOUBLE / buyers_raw AS freq_raw
    FROM k
    """,
)
def agg24(spark, sf_dir):
    bought = table(spark, sf_dir, "orders").select(
        period_of("o_orderdate").alias("period"), F.col("o_custkey").alias("household"),
        "o_orderkey", "o_totalprice",
    )
    kpis = N.panel_kpis(
        bought, _panel_weights(spark, sf_dir), "period", "household", ["o_orderkey"],
        money("o_totalprice"),
    )
    return kpis.withColumn("val_lc", F.col("val_lc").cast("double"))


@query(
    "agg25_diff_stats",
    f"""
    WITH {DIFF_CTE}
    SELECT count_if(row_count > 0)::BIGINT AS total_level1_values,
           count_if(status = 'changed')::BIGINT AS changed_level1, count_if(status = 'new')::BIGINT AS new_level1,
           count_if(status = 'deleted')::BIGINT AS deleted_level1,
           count_if(status = 'unchanged')::BIGINT AS unchanged_level1,
           sum(CASE WHEN status IN ('changed', 'new') THEN row_count ELSE 0 END)::BIGINT
             AS rows_candidate,
           sum(CASE WHEN status = 'unchanged' THEN row_count ELSE 0 END)::BIGINT AS rows_skipped
    FROM d1
    """,
)
def agg25(spark, sf_dir):
    now = G.level1_fingerprint(current_purchases(spark, sf_dir), "period")
    before = G.level1_fingerprint(previous_purchases(spark, sf_dir), "period")
    return G.sync_stats(G.classify(now, before, ["level1_value"]))
