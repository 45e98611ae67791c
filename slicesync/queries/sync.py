"""Differential and incremental synchronisation, and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicesync.functions.periods import moment_literal, period_of, shift_months
from slicesync.operators import fingerprint as G
from slicesync.operators.slices import keep_slices, replace_slices
from slicesync.plans.differential import run_differential_sync
from slicesync.plans.extract import synchronise
from slicesync.plans.fingerprints import FingerprintStore
from slicesync.plans.incremental import beyond, run_incremental_sync, watermark
from slicesync.plans.report import job_report, write_csv, write_parts
from slicesync.plans.slice_source import DatabaseSource
from slicesync.queries.registry import query
from slicesync.queries.shared import (
    AS_OF_ORDERS,
    AS_OF_PURCHASES,
    DIFF_CTE,
    JOBS_CTE,
    PURCHASE_COLUMNS,
    PURCHASES_CTE,
    SCALE,
    STATES_CTE,
    current_purchases,
    jobs,
    prints_sql,
    previous_purchases,
    purchases,
    table,
)
from slicesync.session import run_dir, stage
from slicesync.sources.versions import VersionedTable

SLICE, NAMES = ["period", "l_suppkey"], ["level1_value", "level2_value"]


def level1_status(spark, sf_dir) -> DataFrame:
    now = G.level1_fingerprint(current_purchases(spark, sf_dir), "period")
    before = G.level1_fingerprint(previous_purchases(spark, sf_dir), "period")
    return G.classify(now, before, ["level1_value"])


def changed_slices(spark, sf_dir) -> DataFrame:
    """Slices to synchronise; both levels come from one fingerprint pass per state."""
    now2 = G.level2_fingerprint(
        current_purchases(spark, sf_dir), "period", "l_suppkey")
    before2 = G.level2_fingerprint(
        previous_purchases(spark, sf_dir), "period", "l_suppkey")
    now2, before2 = stage(now2, "now"), stage(before2, "before")
    status1 = G.classify(G.roll_up(now2), G.roll_up(before2), ["level1_value"])
    status2 = G.classify(now2, before2, NAMES)
    return stage(G.slices_to_sync(status1, status2), "slices")


def _target(spark, label: str, partition_by: str | None = "period", bucket_by: str | None = None) -> VersionedTable:
    return VersionedTable(spark, run_dir(spark, label), partition_by=partition_by, bucket_by=bucket_by, buckets=16)


def _store(spark) -> FingerprintStore:
    return FingerprintStore(spark, run_dir(spark, "fingerprints"))


def _sync(source, target, store, **options):
    settings = {"country": "all", "table_name": "purchases", "level1": "period",
                "level2": "l_suppkey", "as_of": AS_OF_PURCHASES, **options}
    return run_differential_sync(source, target, store, **settings)


# --- differential ---------------------------------------------------------

STATUS_SQL = f"WITH {DIFF_CTE} SELECT period AS level1_value, status, row_count, stored_row_count FROM d1"


@query("dif1_classify", STATUS_SQL)
def dif1(spark, sf_dir):
    return level1_status(spark, sf_dir).select(
        "level1_value", "status", F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("stored_row_count", F.lit(0)).alias("stored_row_count"),
    )


@query(
    "dif2_mutable_window",
    f"""
    WITH {DIFF_CTE}
    SELECT period AS level1_value, status, period >= 200105 AS in_window FROM d1
    WHERE status <> 'unchanged'
    """,
)
def dif2(spark, sf_dir):
    flagged = G.in_mutable_window(level1_status(spark, sf_dir), 200105)
    return flagged.where("status <> 'unchanged'").select("level1_value", "status", "in_window")


@query(
    "dif3_drill_down",
    f"WITH {DIFF_CTE} SELECT period AS level1_value, l_suppkey AS level2_value, status, row_count FROM slices",
)
def dif3(spark, sf_dir):
    return changed_slices(spark, sf_dir).withColumn(
        "row_count", F.coalesce("row_count", F.lit(0))
    )


@query(
    "dif4_read_changed",
    f"""
    WITH {DIFF_CTE}
    SELECT period, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_shipdate FROM cur
    WHERE (period, l_suppkey) IN (SELECT period, l_suppkey FROM slices)
    """,
)
def dif4(spark, sf_dir):
    rows = current_purchases(spark, sf_dir).select(
        "period", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"
    )
    return keep_slices(rows, changed_slices(spark, sf_dir), SLICE, NAMES)


@query(
    "dif5_replace_slices",
    f"""
    WITH {DIFF_CTE}
    SELECT {PURCHASE_COLUMNS} FROM prev
    WHERE (period, l_suppkey) NOT IN (SELECT period, l_suppkey FROM slices)
    UNION ALL SELECT {PURCHASE_COLUMNS} FROM cur
    WHERE (period, l_suppkey) IN (SELECT period, l_suppkey FROM slices)
    """,
)
def dif5(spark, sf_dir):
    slices = changed_slices(spark, sf_dir)
    target = _target(spark, "dif5", bucket_by="l_suppkey")
    target.overwrite(previous_purchases(spark, sf_dir))
    # Only the buckets that changed slices fall in are read and written again.
    units = slices.select("level1_value", target.bucket_of("level2_value")).distinct().collect()
    fresh = keep_slices(current_purchases(spark, sf_dir), slices, SLICE, NAMES)
    replaced = replace_slices(target.read(parts=map(tuple, units)), fresh, slices, SLICE, NAMES)
    target.replace_parts(replaced, map(tuple, units))
    return target.read()


@query("dif6_first_sync", f"WITH {STATES_CTE} SELECT {PURCHASE_COLUMNS} FROM cur")
def dif6(spark, sf_dir):
    target = _target(spark, "dif6")
    _sync(current_purchases(spark, sf_dir), target, _store(spark))
    return target.read()


@query(
    "dif7_save_fingerprints",
    f"""
    WITH {STATES_CTE}, f AS ({prints_sql('cur', 'period')})
    SELECT 'all' AS country, 'purchases' AS table_name, 'period' AS level,
           period::VARCHAR AS level1_value, row_count, checksum_xor, checksum_sum, 'job-2' AS job_id
    FROM f
    """,
)
def dif7(spark, sf_dir):
    store = _store(spark)
    for job, rows in (("job-1", previous_purchases), ("job-2", current_purchases)):
        prints = G.level1_fingerprint(rows(spark, sf_dir), "period", method="md5", scale=SCALE)
        store.save(prints, "all", "purchases", "period", job)
    return store.load("all", "purchases", "period").select(
        "country", "table_name", "level", "level1_value", "row_count", "checksum_xor",
        F.col("checksum_sum").cast("string").alias("checksum_sum"), "job_id",
    )


@query(
    "dif8_load_fingerprints",
    f"""
    WITH {STATES_CTE}, f AS ({prints_sql('prev', 'period, l_suppkey')})
    SELECT period::VARCHAR AS level1_value, l_suppkey::VARCHAR AS level2_value, row_count,
           checksum_xor FROM f WHERE period IN (200103, 200104)
    """,
)
def dif8(spark, sf_dir):
    store = _store(spark)
    prints = G.level2_fingerprint(
        previous_purchases(spark, sf_dir), "period", "l_suppkey", method="md5", scale=SCALE)
    store.save(prints, "all", "purchases", "product", "job-1")
    found = store.load("all", "purchases", "product", level1_values=["200103", "200104"])
    return found.select("level1_value", "level2_value", "row_count", "checksum_xor")


STATS = ["changed_level1", "new_level1", "deleted_level1", "unchanged_level1",
         "total_changed_pairs", "rows_downloaded", "rows_skipped"]


def _stats_row(spark, stats) -> DataFrame:
    values = stats.as_dict()
    return spark.createDataFrame(
        [tuple(values[name] for name in STATS)], ", ".join(f"{name} long" for name in STATS)
    )


@query(
    "dif9_full_job",
    f"""
    WITH {DIFF_CTE}
    SELECT count_if(status = 'changed')::BIGINT AS changed_level1, count_if(status = 'new')::BIGINT AS new_level1,
           count_if(status = 'deleted')::BIGINT AS deleted_level1,
           count_if(status = 'unchanged')::BIGINT AS unchanged_level1,
           (SELECT count(*) FROM slices) AS total_changed_pairs,
           (SELECT sum(row_count)::BIGINT FROM slices) AS rows_downloaded,
           (sum(row_count) - (SELECT sum(row_count) FROM slices))::BIGINT AS rows_skipped
    FROM d1
    """,
)
def dif9(spark, sf_dir):
    target, store = _target(spark, "dif9"), _store(spark)
    _sync(previous_purchases(spark, sf_dir), target, store)
    return _stats_row(spark, _sync(current_purchases(spark, sf_dir), target, store))


@query(
    "dif10_no_change",
    f"""
    WITH {STATES_CTE}
    SELECT 0::BIGINT AS changed_level1, 0::BIGINT AS new_level1, 0::BIGINT AS deleted_level1,
           count(DISTINCT period) AS unchanged_level1, 0::BIGINT AS total_changed_pairs,
           0::BIGINT AS rows_downloaded, count(*) AS rows_skipped FROM cur
    """,
)
def dif10(spark, sf_dir):
    target, store = _target(spark, "dif10"), _store(spark)
    _sync(current_purchases(spark, sf_dir), target, store)
    return _stats_row(spark, _sync(current_purchases(spark, sf_dir), target, store))


@query(
    "dif11_out_of_scope_kept",
    f"""
    WITH {PURCHASES_CTE}
    SELECT period, count(*) AS row_count, sum(l_quantity)::DOUBLE AS quantity FROM p GROUP BY 1
    """,
)
def dif11(spark, sf_dir):
    """Rows of the month that left the scope stay; everything else is as in the source."""
    target, store = _target(spark, "dif11"), _store(spark)
    _sync(previous_purchases(spark, sf_dir), target, store)
    _sync(current_purchases(spark, sf_dir), target, store)
    return target.read().groupBy("period").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("l_quantity").alias("quantity")
    )


# --- incremental ----------------------------------------------------------

CUT = datetime(2024, 1, 20)
BOUNDARY_MONTHS = 3  # before AS_OF_ORDERS, so the window starts on 2001-05-02


def _events_before_cut(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("ts") < moment_literal(CUT))


def _append_sync(spark, source, target, store, **options):
    return run_incremental_sync(
        source, target, store, country="all", table_name="events", key="event_id", **options
    )


@query("inc1_first_sync", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def inc1(spark, sf_dir):
    target = _target(spark, "inc1", None)
    _append_sync(spark, table(spark, sf_dir, "events"), target, _store(spark))
    return target.read()


@query(
    "inc2_append_beyond_watermark",
    """
    SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE ts < '2024-01-20'
    UNION ALL
    SELECT event_id, ts, user_id, event_type, value, props FROM events
    WHERE event_id > (SELECT max(event_id) FROM events WHERE ts < '2024-01-20')
    """,
)
def inc2(spark, sf_dir):
    target, store = _target(spark, "inc2", None), _store(spark)
    _append_sync(spark, _events_before_cut(spark, sf_dir), target, store)
    _append_sync(spark, table(spark, sf_dir, "events"), target, store)
    return target.read()


def _dated_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("period", period_of("o_orderdate"))


def _orders_before(spark, sf_dir):
    """Orders as they were in mid-June: without later ones, open ones still cheaper."""
    return _dated_orders(spark, sf_dir).where(
        F.col("o_orderdate") < moment_literal(datetime(2001, 6, 15))
    ).withColumn(
        "o_totalprice",
        F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") / 2)
        .otherwise(F.col("o_totalprice")),
    )


def _window_sync(source, target, store, **options):
    return run_incremental_sync(
        source, target, store, country="all", table_name="orders", key="o_orderkey",
        date_column="o_orderdate", mutable_months=BOUNDARY_MONTHS, as_of=AS_OF_ORDERS, **options
    )


BEFORE_CTE = """
o AS (SELECT *, (year(o_orderdate) * 100 + month(o_orderdate))::INT AS period FROM orders),
before AS (
  SELECT * REPLACE (CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 2 ELSE o_totalprice END
                    AS o_totalprice)
  FROM o WHERE o_orderdate < '2001-06-15'
)"""


@query(
    "inc3_replace_window",
    f"""
    WITH {BEFORE_CTE}
    SELECT * FROM before WHERE o_orderdate < '2001-05-02'
    UNION ALL SELECT * FROM o WHERE o_orderdate >= '2001-05-02'
    """,
)
def inc3(spark, sf_dir):
    target, store = _target(spark, "inc3"), _store(spark)
    _window_sync(_orders_before(spark, sf_dir), target, store)
    _window_sync(_dated_orders(spark, sf_dir), target, store)
    return target.read()


@query(
    "inc4_hybrid",
    f"""
    WITH {BEFORE_CTE}, b AS (SELECT * FROM before WHERE o_orderpriority <> '5-LOW')
    SELECT * FROM b WHERE o_orderdate < '2001-05-02'
    UNION ALL SELECT * FROM o WHERE o_orderdate >= '2001-05-02'
    UNION ALL SELECT * FROM o
    WHERE o_orderdate < '2001-05-02' AND o_orderkey > (SELECT max(o_orderkey) FROM b)
    """,
)
def inc4(spark, sf_dir):
    target, store = _target(spark, "inc4"), _store(spark)
    known = _orders_before(spark, sf_dir).where("o_orderpriority <> '5-LOW'")
    _window_sync(known, target, store)
    _window_sync(_dated_orders(spark, sf_dir), target, store)
    return target.read()


@query(
    "inc_late_rows",
    "SELECT event_id, ts, user_id, event_type, value, props FROM events",
)
def inc_late(spark, sf_dir):
    """Errors are reported after other events with higher ids; the ranges that grew give them."""
    target, store, width = _target(spark, "inc-late", None), _store(spark), 500
    punctual = _events_before_cut(spark, sf_dir).where("event_type <> 'error'")
    _append_sync(spark, punctual, target, store, range_keys=width)
    _append_sync(spark, table(spark, sf_dir, "events"), target, store, range_keys=width)
    return target.read()


@query(
    "inc_late_rows_and_window",
    f"""
    WITH {BEFORE_CTE}, b AS (SELECT * FROM before WHERE o_orderpriority <> '5-LOW')
    SELECT * FROM b WHERE o_orderdate < '2001-05-02'
    UNION ALL SELECT * FROM o WHERE o_orderdate >= '2001-05-02'
    UNION ALL SELECT * FROM o
    WHERE o_orderdate < '2001-05-02' AND o_orderkey NOT IN (SELECT o_orderkey FROM b)
    """,
)
def inc_late_window(spark, sf_dir):
    """Low-priority orders come late, of all dates, while the window changes too."""
    target, store = _target(spark, "inc-late-window"), _store(spark)
    known = _orders_before(spark, sf_dir).where("o_orderpriority <> '5-LOW'")
    for source in (known, _dated_orders(spark, sf_dir)):
        _window_sync(source, target, store, range_keys=1_000)
    return target.read()


@query(
    "inc5_mode_choice",
    """
    SELECT * FROM (VALUES (1, 'full', (SELECT count(*) FROM customer)),
      (2, 'full', (SELECT count(*) FROM customer)),
      (3, 'differential', (SELECT count(*) FROM customer)),
      (4, 'incremental', (SELECT count(*) FROM customer))) t(run, mode, row_count)
    """,
)
def inc5(spark, sf_dir):
    source = table(spark, sf_dir, "customer")
    by_slice = {"level1": "c_mktsegment", "level2": "c_nationkey"}
    by_key = {"key": "c_custkey"}
    runs = [
        {"force_full": True, "differential": by_slice},
        {},
        {"differential": by_slice, "incremental": by_key},
        {"incremental": by_key},
    ]
    rows = []
    for number, settings in enumerate(runs, 1):
        target = _target(spark, "inc5", "c_mktsegment")
        done = synchronise(
            source, target, _store(spark), country="all", table_name="customer", **settings
        )
        rows.append((number, done["mode"], done["rows"]))
    return spark.createDataFrame(rows, "run int, mode string, row_count long")


@query(
    "inc_beyond_watermark_rows",
    """
    SELECT o_orderkey, o_orderdate FROM orders
    WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders
                        WHERE o_orderkey <= (SELECT avg(o_orderkey) FROM orders))
      AND o_orderdate < '2001-05-02'
    """,
)
def inc_beyond(spark, sf_dir):
    """Half of the keys are known; rows of the window are left to its refresh."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    known = orders.where(F.col("o_orderkey") <= orders.agg(F.avg("o_orderkey")).scalar())
    highest = watermark(known, "o_orderkey").first()[0]
    return beyond(orders, "o_orderkey", highest, "o_orderdate", datetime(2001, 5, 2))


# --- changes of mode, and changes that are easily missed --------------------

@query(
    "dif_forced_full_between",
    f"WITH {STATES_CTE} SELECT {PURCHASE_COLUMNS} FROM cur",
)
def dif_forced_full(spark, sf_dir):
    """Differential, a forced full run of another state, differential to the first again."""
    target, store = _target(spark, "dif-modes"), _store(spark)
    settings = {"country": "all", "table_name": "purchases", "as_of": AS_OF_PURCHASES,
                "differential": {"level1": "period", "level2": "l_suppkey"}}
    first = current_purchases(spark, sf_dir)
    other = first.withColumn("l_quantity", F.col("l_quantity") + F.col("l_suppkey") % 3)
    synchronise(first, target, store, **settings)
    synchronise(other, target, store, force_full=True, **settings)
    synchronise(first, target, store, **settings)
    return target.read()


@query(
    "inc_forced_full_between",
    """
    SELECT *, (year(o_orderdate) * 100 + month(o_orderdate))::INT AS period FROM orders
    """,
)
def inc_forced_full(spark, sf_dir):
    """The same for the incremental mode; the other state differs within the window."""
    target, store = _target(spark, "inc-modes"), _store(spark)
    settings = {"country": "all", "table_name": "orders", "as_of": AS_OF_ORDERS,
                "incremental": {"key": "o_orderkey", "date_column": "o_orderdate",
                                "mutable_months": BOUNDARY_MONTHS}}
    first = _dated_orders(spark, sf_dir)
    recent = F.col("o_orderdate") >= moment_literal(shift_months(AS_OF_ORDERS, -BOUNDARY_MONTHS))
    other = first.withColumn(
        "o_totalprice", F.when(recent, F.col("o_totalprice") / 2).otherwise(F.col("o_totalprice")))
    synchronise(first, target, store, **settings)
    synchronise(other, target, store, force_full=True, **settings)
    synchronise(first, target, store, **settings)
    return target.read()


def _synced(spark, before: DataFrame, now: DataFrame, label: str) -> DataFrame:
    """The target after two differential syncs, by market segment and nation."""
    target, store = _target(spark, label, "c_mktsegment"), _store(spark)
    for state in (before, now):
        _sync(state, target, store, level1="c_mktsegment", level2="c_nationkey")
    return target.read()


@query(
    "dif_framed_values",
    """
    SELECT 'sync' AS how, c_custkey, c_name AS a, '|' || c_phone AS b FROM (
      SELECT *, c_custkey::VARCHAR AS c_phone FROM customer)
    UNION ALL SELECT 'sync', -1 - c_custkey, '<null>', NULL FROM customer
    """,
)
def dif_framed(spark, sf_dir):
    """Text that moves to the next column, and the text of a mark for NULL, are changes."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    phone = F.col("c_custkey").cast("string")
    keys = ["c_mktsegment", "c_nationkey"]

    def state(a, b, c, d):
        moved = customer.select("c_custkey", a.alias("a"), b.alias("b"), *keys)
        return moved.unionByName(customer.select(
            (-1 - F.col("c_custkey")).alias("c_custkey"), c.alias("a"), d.alias("b"), *keys))

    none, mark = F.lit(None).cast("string"), F.lit("<null>")
    before = state(F.concat("c_name", F.lit("|")), phone, none, mark)
    now = state(F.col("c_name"), F.concat(F.lit("|"), phone), mark, none)
    return _synced(spark, before, now, "dif-framed").select(F.lit("sync").alias("how"), "c_custkey", "a", "b")


@query(
    "dif_framed_portable_hash",
    "SELECT c_mktsegment AS level1_value, 'changed' AS status FROM customer GROUP BY 1",
)
def dif_framed_portable(spark, sf_dir):
    """The portable hash sees what moves between columns, too."""
    customer = table(spark, sf_dir, "customer")
    before = customer.select("c_mktsegment", F.concat("c_name", F.lit("|")).alias("a"), F.lit("x").alias("b"))
    now = customer.select("c_mktsegment", F.col("c_name").alias("a"), F.lit("|x").alias("b"))
    prints = [G.level1_fingerprint(x, "c_mktsegment", method="md5") for x in (now, before)]
    return G.classify(*prints, ["level1_value"]).select("level1_value", "status")


@query(
    "dif_nested_nulls",
    """
    SELECT c_custkey, 1 AS items, NULL::BIGINT AS p, c_custkey AS q, c_acctbal + 2e-7 AS balance
    FROM customer
    """,
)
def dif_nested(spark, sf_dir):
    """A NULL that leaves an array or moves in a struct is a change, as is 2e-7."""
    customer = table(spark, sf_dir, "customer")
    key, none = F.col("c_custkey"), F.lit(None).cast("long")

    def state(items, p, q, more):
        return customer.select(
            "c_custkey", items.alias("v"), F.struct(p.alias("p"), q.alias("q")).alias("s"),
            (F.col("c_acctbal") + F.lit(more)).alias("balance"), "c_mktsegment", "c_nationkey")

    before, now = state(F.array(key, none), key, none, 0.0), state(F.array(key), none, key, 2e-7)
    return _synced(spark, before, now, "dif-nested").select(
        "c_custkey", F.size("v").alias("items"), "s.p", "s.q", "balance")


# --- sinks ----------------------------------------------------------------

@query("snk1_overwrite", "SELECT * FROM supplier")
def snk1(spark, sf_dir):
    target = _target(spark, "snk1", None)
    target.overwrite(table(spark, sf_dir, "customer"))
    target.overwrite(table(spark, sf_dir, "supplier"))
    return target.read()


@query(
    "snk2_append",
    """
    SELECT c_custkey AS code, c_name AS name, c_nationkey AS nation FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier
    """,
)
def snk2(spark, sf_dir):
    target = _target(spark, "snk2", None)
    target.append(table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS code", "c_name AS name", "c_nationkey AS nation"))
    target.append(table(spark, sf_dir, "supplier").selectExpr(
        "s_nationkey AS NATION", "s_name AS NAME", "s_suppkey AS CODE"))
    return target.read()


@query("snk3_empty_table", "SELECT * FROM orders WHERE o_orderstatus = 'none'")
def snk3(spark, sf_dir):
    target = _target(spark, "snk3", None)
    orders = table(spark, sf_dir, "orders")
    target.overwrite(orders)
    target.overwrite(orders.where("o_orderstatus = 'none'"))
    return target.read()


@query("snk4_skip_existing", "SELECT * FROM customer")
def snk4(spark, sf_dir):
    target = _target(spark, "snk4", "c_mktsegment")
    customers = table(spark, sf_dir, "customer")
    target.write_if_absent(customers)
    target.write_if_absent(customers.where("c_acctbal < 0"))
    return target.read()


@query("snk5_sized_parts", "SELECT * FROM orders")
def snk5(spark, sf_dir):
    path = run_dir(spark, "snk5")
    orders = table(spark, sf_dir, "orders")
    write_parts(orders, path, rows_per_file=2_000, partition_by=("o_orderstatus",))
    return spark.read.schema(orders.schema).parquet(path)


def report_tables(spark, sf_dir):
    headers = jobs(spark, sf_dir)
    results = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.concat_ws("-", F.lit("query"), "l_linenumber").alias("query_name"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("status"),
        F.floor("l_quantity").alias("rows_extracted"),
        F.when(F.col("l_returnflag") == "R", "returned, by customer").alias("error"),
    )
    steps = headers.select(
        "job_id", F.col("stage").alias("step_name"), "status", "error"
    )
    return headers, results, steps


@query(
    "snk7_csv_report",
    f"""
    WITH {JOBS_CTE}
    SELECT 'job' AS section, job_id, job_id::VARCHAR AS name, status, NULL::BIGINT AS rows_extracted,
           NULL AS error FROM j
    UNION ALL SELECT 'step', job_id, stage, status, NULL, NULL FROM j
    UNION ALL SELECT 'query', l_orderkey, 'query-' || l_linenumber,
           CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END,
           floor(l_quantity)::BIGINT,
           CASE WHEN l_returnflag = 'R' THEN 'returned, by customer' END FROM lineitem
    """,
)
def snk7(spark, sf_dir):
    path = run_dir(spark, "snk7")
    headers, results, steps = report_tables(spark, sf_dir)
    report = job_report(headers, results, steps)
    write_csv(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


@query(
    "dif_pushed_down_fingerprints",
    f"""
    WITH {PURCHASES_CTE}
    SELECT period, count(*) AS row_count, sum(l_quantity)::DOUBLE AS quantity FROM p GROUP BY 1
    """,
)
def dif_pushed_down(spark, sf_dir):
    """The same sync where the source's own SQL engine computes the fingerprints."""
    target, store = _target(spark, "pushed"), _store(spark)
    for number, rows in enumerate((previous_purchases, current_purchases), 1):
        view = f"slicesync_pushed_{number}"
        rows(spark, sf_dir).createOrReplaceTempView(view)
        source = DatabaseSource(
            view, "period", "l_suppkey",
            run=spark.sql,
            read=lambda predicates, view=view: spark.table(view).where(
                " OR ".join(f"({predicate})" for predicate in predicates)
            ),
            read_all=lambda view=view: spark.table(view),
            row_hash="xxhash64(*)", xor="bit_xor",
            hash_sum="sum(cast(xxhash64(*) AS decimal(20,0)))",
            bucket_hash="abs(cast(hash({}) AS bigint))", parallel=True,
        )
        _sync(source, target, store)
    return target.read().groupBy("period").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("l_quantity").alias("quantity")
    )
