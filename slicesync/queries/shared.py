"""Stand-ins: the panel's tables expressed over the test tables.

Purchases are ``lineitem`` with the period of their ship date, headers are
``orders``, tenants are nations and servers are regions. The previous state of
the purchases lacks the latest months (these are new slices) and has larger
quantities in one month (these slices changed); the current state no longer
reaches back to the first month (out of scope).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicesync.functions.periods import period_of, period_range_of

AS_OF_PURCHASES = datetime(2001, 11, 5)
AS_OF_ORDERS = datetime(2001, 8, 2)
AS_OF_EVENTS = datetime(2024, 1, 31)

FIRST_PERIOD, CORRECTED_PERIOD, FIRST_NEW_PERIOD = 199501, 200103, 200107


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str | Column) -> Column:
    """Exact amounts, so that sums do not depend on the order of rows."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("decimal(18,4)")


# --- purchases ------------------------------------------------------------

def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("period", period_of("l_shipdate"))


def current_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchases(spark, sf_dir).where(
        ~period_range_of("l_shipdate", FIRST_PERIOD, FIRST_PERIOD)
    )


def previous_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = purchases(spark, sf_dir).where(F.col("l_shipdate") < F.lit("2001-07-01").cast(
        "timestamp_ntz"))
    corrected = (F.col("period") == CORRECTED_PERIOD) & (F.col("l_quantity") >= 49)
    return rows.withColumn(
        "l_quantity",
        F.when(corrected, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")),
    )


PURCHASE_COLUMNS = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
    "l_tax, l_returnflag, l_linestatus, l_shipdate, period"
)
#: Places at which amounts are compared by the portable hash.
SCALE = 6
_DOUBLES = {"l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice"}


def hash_sql(columns: str) -> str:
    """SQL of the portable row hash over the named columns."""
    texts = []
    for name in columns.replace(" ", "").split(","):
        value = f"({name}::DECIMAL(38,{SCALE}))" if name in _DOUBLES else name
        text = f"{value}::VARCHAR"
        texts.append(f"coalesce(length({text}) || ':' || {text}, 'N')")
    digest = f"('0x' || substr(md5({' || '.join(texts)}), 1, 16))::UBIGINT::HUGEINT"
    return f"({digest} - CASE WHEN {digest} >= {1 << 63} THEN {1 << 64}::HUGEINT ELSE 0 END)::BIGINT"


PURCHASES_CTE = """
p AS (
  SELECT *, (year(l_shipdate) * 100 + month(l_shipdate))::INT AS period FROM lineitem
)"""

STATES_CTE = f"""{PURCHASES_CTE},
cur AS (SELECT {PURCHASE_COLUMNS} FROM p WHERE period <> {FIRST_PERIOD}),
prev AS (
  SELECT * REPLACE (CASE WHEN period = {CORRECTED_PERIOD} AND l_quantity >= 49
                         THEN l_quantity + 1 ELSE l_quantity END AS l_quantity)
  FROM p WHERE period < {FIRST_NEW_PERIOD}
)"""


def prints_sql(source: str, keys: str, columns: str = PURCHASE_COLUMNS) -> str:
    """SQL of the fingerprints of ``source`` per combination of ``keys``."""
    return f"""
  SELECT {keys}, count(*) AS row_count, bit_xor(h) AS checksum_xor,
         sum(h::HUGEINT + CASE WHEN h < 0 THEN {1 << 64}::HUGEINT ELSE 0 END)::VARCHAR AS checksum_sum
  FROM (SELECT *, {hash_sql(columns)} AS h FROM {source}) GROUP BY {keys}"""


# Changed and new slices between the two states, and the status of each.
DIFF_CTE = f"""{STATES_CTE},
c1 AS ({prints_sql('cur', 'period')}),
s1 AS ({prints_sql('prev', 'period')}),
d1 AS (
  SELECT coalesce(c1.period, s1.period) AS period,
         CASE WHEN s1.period IS NULL THEN 'new' WHEN c1.period IS NULL THEN 'deleted'
              WHEN c1.row_count = s1.row_count AND c1.checksum_xor = s1.checksum_xor
                   AND c1.checksum_sum = s1.checksum_sum THEN 'unchanged'
              ELSE 'changed' END AS status,
         coalesce(c1.row_count, 0) AS row_count, coalesce(s1.row_count, 0) AS stored_row_count
  FROM c1 FULL OUTER JOIN s1 ON c1.period = s1.period
),
c2 AS ({prints_sql('cur', 'period, l_suppkey')}),
s2 AS ({prints_sql('prev', 'period, l_suppkey')}),
d2 AS (
  SELECT coalesce(c2.period, s2.period) AS period, coalesce(c2.l_suppkey, s2.l_suppkey) AS l_suppkey,
         CASE WHEN s2.period IS NULL THEN 'new' WHEN c2.period IS NULL THEN 'deleted'
              WHEN c2.row_count = s2.row_count AND c2.checksum_xor = s2.checksum_xor
                   AND c2.checksum_sum = s2.checksum_sum THEN 'unchanged'
              ELSE 'changed' END AS status,
         coalesce(c2.row_count, 0) AS row_count
  FROM c2 FULL OUTER JOIN s2 ON c2.period = s2.period AND c2.l_suppkey = s2.l_suppkey
),
slices AS (
  SELECT d2.period, d2.l_suppkey, d2.status, d2.row_count
  FROM d2 JOIN d1 ON d1.period = d2.period
  WHERE d1.status = 'new' OR (d1.status = 'changed' AND d2.status <> 'unchanged')
)"""


# --- tenants and servers --------------------------------------------------

def customers_with_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


def region_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """The servers, as the small table that lists them has them."""
    return [row[0] for row in table(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect()]


CUSTOMERS_SQL = """(
  SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


# --- queue, jobs, audit ---------------------------------------------------

def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event queue: one entry per row of ``events``."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("ev-"), F.col("event_id")).alias("event_id"),
        F.when(kind.isin("purchase", "signup"), "INSERT").when(kind == "view", "UPDATE")
        .when(kind == "click", "DELETE").otherwise("NONE").alias("operation"),
        F.lit("lake.sales.orders").alias("source_table"),
        F.concat(F.lit("dbo."), kind).alias("target_table"),
        F.when(kind.isin("view", "click"), F.array(F.lit("user_id")))
        .otherwise(F.array().cast("array<string>")).alias("primary_keys"),
        (F.col("event_id") % 10).cast("int").alias("priority"),
        F.when(kind.isin("purchase", "click"), "pending").when(kind == "view", "completed")
        .when(kind == "signup", "processing").otherwise("failed").alias("status"),
        F.floor("value").alias("rows_expected"),
        F.when(kind == "view", F.floor("value")).alias("rows_affected"),
        F.lit(None).cast("long").alias("discrepancy"),
        F.lit(None).cast("string").alias("warning"),
        F.when(kind == "error", "connection lost").alias("error_message"),
        F.lit(0).alias("retry_count"),
        F.lit(3).alias("max_retries"),
        F.col("props").alias("filter_conditions"),
        F.lit(None).cast("string").alias("metadata"),
        F.col("ts").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("processed_at"),
    )


QUEUE_CTE = """
q AS (
  SELECT 'ev-' || event_id AS event_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'INSERT'
              WHEN event_type = 'view' THEN 'UPDATE'
              WHEN event_type = 'click' THEN 'DELETE' ELSE 'NONE' END AS operation,
         'dbo.' || event_type AS target_table,
         (event_id % 10)::INT AS priority,
         CASE WHEN event_type IN ('purchase', 'click') THEN 'pending'
              WHEN event_type = 'view' THEN 'completed'
              WHEN event_type = 'signup' THEN 'processing' ELSE 'failed' END AS status,
         floor(value)::BIGINT AS rows_expected,
         CASE WHEN event_type = 'error' THEN 'connection lost' END AS error_message,
         props AS filter_conditions, ts AS created_at, user_id
  FROM events
)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per order: its nation is the tenant, its priority the stage."""
    owners = customers_with_nation(spark, sf_dir).select("c_custkey", "n_name")
    status = F.col("o_orderstatus")
    return (
        table(spark, sf_dir, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("job_id"),
            F.col("n_name").alias("country"),
            F.col("o_orderpriority").alias("stage"),
            F.when(status == "F", "completed").when(status == "O", "running")
            .otherwise("pending").alias("status"),
            F.col("o_orderdate").alias("created_at"),
            F.when(status == "F", F.col("o_orderdate")).alias("completed_at"),
            F.lit(None).cast("string").alias("error"),
        )
    )


JOBS_CTE = """
j AS (
  SELECT o_orderkey AS job_id, n_name AS country, o_orderpriority AS stage,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running'
              ELSE 'pending' END AS status,
         o_orderdate AS created_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completed_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
