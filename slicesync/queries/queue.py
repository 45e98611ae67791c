"""Reverse apply, the event queue, permissions, audit and streams."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicesync.functions.periods import moment_literal
from slicesync.operators import apply as A
from slicesync.operators import events as E
from slicesync.operators.audit import audit_rows, search, severity
from slicesync.operators.permissions import decide
from slicesync.operators.fingerprint import fingerprint
from slicesync.operators.print_changes import change_prints, moved_on, wrong_slices
from slicesync.plans.fingerprints import FingerprintStore
from slicesync.plans.fold import NamedSources, RowSource, apply_all, fold_events
from slicesync.plans.reverse import EventApplier
from slicesync.queries.joins import (
    GRANTS_SQL,
    UPDATED_SQL,
    grants,
    permission_requests,
    price_corrections,
)
from slicesync.queries.registry import query
from slicesync.queries.shared import (
    AS_OF_EVENTS,
    JOBS_CTE,
    PURCHASE_COLUMNS,
    PURCHASES_CTE,
    QUEUE_CTE,
    SCALE,
    jobs,
    prints_sql,
    purchases,
    queue_events,
    table,
)
from slicesync.session import run_dir
from slicesync.sources.versions import VersionedTable
from slicesync.streaming.event_stream import read_events, stream_apply, stream_status

CUT = datetime(2001, 1, 1)
PROCESSED_AT = datetime(2024, 2, 1)


class Desk:
    """Sources and targets of a queue that works on the orders."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.root = run_dir(spark, "targets")
        known = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < moment_literal(CUT))
        self.target("dbo.orders").overwrite(known)

    def source(self, name: str) -> DataFrame:
        orders = table(self.spark, self.sf_dir, "orders")
        return {
            "lake.sales.new_orders": lambda: orders.where(
                F.col("o_orderdate") >= moment_literal(CUT)
            ),
            "lake.sales.corrections": lambda: price_corrections(self.spark, self.sf_dir),
            "lake.sales.nothing": lambda: orders.where("o_orderstatus = 'none'"),
            "lake.sales.repeated": lambda: orders.unionByName(orders),
        }[name]()

    def target(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}", partition_by="o_orderstatus")

    def applier(self, **options) -> EventApplier:
        settings = {"max_delete_rows": None, "clock": lambda: PROCESSED_AT, **options}
        return EventApplier(self.source, self.target, **settings)

    def queue(self, *entries: dict) -> DataFrame:
        """Events in the given order of urgency."""
        rows = [
            {
                "event_id": f"e{i}", "priority": 10 - i, "target_table": "dbo.orders",
                "source_table": "", "primary_keys": ["o_orderkey"], "rows_expected": None,
                "filter_conditions": None, "metadata": None, **entry,
            }
            for i, entry in enumerate(entries, 1)
        ]
        requests = self.spark.createDataFrame(
            [tuple(row[name] for name in REQUEST) for row in rows],
            "event_id string, operation string, source_table string, target_table string, "
            "primary_keys array<string>, priority int, rows_expected long, "
            "filter_conditions string, metadata string",
        )
        return E.new_events(requests, moment_literal(AS_OF_EVENTS))


REQUEST = ["event_id", "operation", "source_table", "target_table", "primary_keys", "priority",
           "rows_expected", "filter_conditions", "metadata"]
INSERT = {"operation": "INSERT", "source_table": "lake.sales.new_orders"}
UPDATE = {"operation": "UPDATE", "source_table": "lake.sales.corrections"}
DELETE = {"operation": "DELETE", "filter_conditions": json.dumps({"o_orderstatus": "P"})}


@query("rev1_insert", "SELECT * FROM orders")
def rev1(spark, sf_dir):
    desk = Desk(spark, sf_dir)
    apply_all(desk.queue(INSERT), desk.applier())
    return desk.target("dbo.orders").read()


@query("rev2_update", UPDATED_SQL.format(extra="") + " WHERE o_orderdate < '2001-01-01'")
def rev2(spark, sf_dir):
    desk = Desk(spark, sf_dir)
    apply_all(desk.queue(UPDATE), desk.applier())
    return desk.target("dbo.orders").read()


@query(
    "rev3_delete",
    "SELECT * FROM orders WHERE o_orderdate < '2001-01-01' AND o_orderstatus <> 'P'",
)
def rev3(spark, sf_dir):
    desk = Desk(spark, sf_dir)
    apply_all(desk.queue(DELETE), desk.applier())
    return desk.target("dbo.orders").read()


@query(
    "rev3_delete_over_cap",
    """
    WITH n AS (SELECT count(*) AS n FROM orders WHERE o_orderdate < '2001-01-01' AND o_orderstatus = 'P')
    SELECT 'failed' AS status, 0::BIGINT AS rows_affected, true AS says_why,
           (SELECT count(*) FROM orders WHERE o_orderdate < '2001-01-01') AS rows_left FROM n WHERE n > 1
    """,
)
def rev3_over_cap(spark, sf_dir):
    """A delete beyond the cap is refused whole."""
    desk = Desk(spark, sf_dir)
    results = apply_all(desk.queue(DELETE), desk.applier(max_delete_rows=1))
    left = desk.target("dbo.orders").read().agg(F.count(F.lit(1)).alias("rows_left"))
    return results.select(
        "status", "rows_affected", F.col("error_message").contains("1").alias("says_why"),
        left.scalar().alias("rows_left"),
    )


@query(
    "rev4_discrepancy",
    """
    SELECT event_id, CASE WHEN floor(value) <> user_id THEN floor(value)::BIGINT - user_id END
             AS discrepancy FROM events
    """,
)
def rev4(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", A.discrepancy(F.floor("value"), F.col("user_id")).alias("discrepancy")
    )


REQUESTS_SQL = QUEUE_CTE + """,
requests AS (
  SELECT event_id, operation, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END AS keys,
         CASE user_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN 'not json' ELSE '{"k": "1"}' END AS conditions
  FROM q
)"""


@query(
    "rev5_validation",
    f"""
    WITH {REQUESTS_SQL}
    SELECT event_id, CASE
        WHEN operation NOT IN ('INSERT', 'UPDATE', 'DELETE') THEN 'unknown operation'
        WHEN operation IN ('UPDATE', 'DELETE') AND keys = 0 THEN 'primary keys are required'
        WHEN operation = 'DELETE' AND length(conditions) = 2 THEN 'conditions are required'
        WHEN conditions = 'not json' OR length(conditions) = 2
          THEN 'filter_conditions is not a JSON object' END AS problem
    FROM requests
    """,
)
def rev5(spark, sf_dir):
    """Every third request has no keys; conditions are empty, broken or good in turn."""
    user = table(spark, sf_dir, "events").select(
        F.concat(F.lit("ev-"), F.col("event_id")).alias("event_id"), "user_id")
    turn = F.col("user_id") % 4
    requests = queue_events(spark, sf_dir).join(user, "event_id").withColumns({
        "primary_keys": F.when(F.col("user_id") % 3 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("user_id"))),
        "filter_conditions": F.when(turn == 0, "{}").when(turn == 1, "not json")
        .otherwise('{"k": "1"}'),
    })
    return requests.select(
        "event_id", F.coalesce(E.request_problem(), E.conditions_problem()).alias("problem")
    )


@query(
    "rev6_route_events",
    """
    WITH n AS (SELECT count(*) AS n FROM orders WHERE o_orderdate >= '2001-01-01'),
    u AS (SELECT count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED')),
    d AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P')
    SELECT 'e1' AS event_id, 'completed' AS status, n AS rows_affected, NULL AS discrepancy,
           NULL AS warning, NULL AS error_message FROM n
    UNION ALL SELECT 'e2', 'completed', n, 5 - n, NULL, NULL FROM u
    UNION ALL SELECT 'e3', 'completed', n, NULL, NULL, NULL FROM d
    UNION ALL SELECT 'e4', 'completed', 0, NULL, 'no data to insert', NULL
    UNION ALL SELECT 'e5', 'failed', 0, NULL, NULL, 'unknown operation: MERGE'
    UNION ALL SELECT 'e6', 'failed', 0, NULL, NULL, 'primary keys are required for DELETE'
    UNION ALL SELECT 'e7', 'failed', 0, NULL, NULL,
                     'duplicate primary keys in the source of an update'
    UNION ALL SELECT 'e8', 'failed', 0, NULL, NULL, 'at least one condition is required'
    UNION ALL SELECT 'e9', 'failed', 0, NULL, NULL, 'filter_conditions is not valid JSON'
    """,
)
def rev6(spark, sf_dir):
    desk = Desk(spark, sf_dir)
    events = desk.queue(
        INSERT,
        {**UPDATE, "rows_expected": 5},
        DELETE,
        {"operation": "INSERT", "source_table": "lake.sales.nothing"},
        {"operation": "MERGE"},
        {**DELETE, "primary_keys": []},
        {"operation": "UPDATE", "source_table": "lake.sales.repeated"},
        {"operation": "DELETE", "filter_conditions": "{}"},
        {"operation": "DELETE", "filter_conditions": "{not json"},
    )
    return apply_all(events, desk.applier()).drop("processed_at")


# Every row of ``events`` is an event of its own, over three targets that begin with the customers.
FOLD_CTE = """
e AS (
  SELECT 'ev-' || event_id AS event_id, event_id % 3 AS t, user_id, value, row_number() OVER (ORDER BY ts, 'ev-' || event_id) AS o,
         CASE WHEN event_type IN ('signup', 'purchase') THEN 'INSERT' WHEN event_type = 'view' THEN 'UPDATE'
              WHEN event_type = 'click' THEN 'DELETE' ELSE 'NONE' END AS op FROM events),
i AS (
  SELECT t, c_custkey AS user_id, c_acctbal AS value, 0 AS o FROM customer, (SELECT unnest([0, 1, 2]) AS t)
  UNION ALL SELECT t, user_id, value, o FROM e WHERE op = 'INSERT'),
d AS (
  SELECT i.t, i.user_id, i.value, i.o, min(e.o) AS gone FROM i
  LEFT JOIN e ON e.op = 'DELETE' AND e.t = i.t AND e.user_id = i.user_id AND e.o > i.o GROUP BY ALL)"""


def fold_queue(spark, sf_dir):
    """The queue of all events, its targets, and its results."""
    events, root = table(spark, sf_dir, "events"), run_dir(spark, "fold")
    kind = F.col("event_type")
    requests = events.select(
        F.concat(F.lit("ev-"), "event_id").alias("event_id"),
        F.when(kind.isin("signup", "purchase"), "INSERT").when(kind == "view", "UPDATE").when(kind == "click", "DELETE")
        .otherwise("NONE").alias("operation"),
        F.concat(F.lit("lake.queue.ev-"), "event_id").alias("source_table"),
        F.concat(F.lit("dbo.users_"), F.col("event_id") % 3).alias("target_table"), F.array(F.lit("user_id")).alias("primary_keys"),
        F.when(kind == "click", F.to_json(F.struct("user_id"))).alias("filter_conditions"), "ts")
    rows = events.select(F.concat(F.lit("lake.queue.ev-"), "event_id").alias("source_table"), "user_id", "value")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    targets = {f"dbo.users_{t}": VersionedTable(spark, f"{root}/users_{t}") for t in range(3)}
    for target in targets.values():
        target.overwrite(known)
    results = fold_events(
        E.new_events(requests, F.col("ts")), RowSource(rows, "source_table"), targets.__getitem__, None,
        clock=lambda: PROCESSED_AT)
    return targets, results


@query(
    "rev6_fold_targets",
    f"""
    WITH {FOLD_CTE},
    u AS (
      SELECT d.t, d.user_id, d.o, d.value, arg_max(e.value, e.o) AS latest, count(*) AS copies
      FROM (SELECT *, row_number() OVER () AS r FROM d WHERE gone IS NULL) d
      LEFT JOIN e ON e.op = 'UPDATE' AND e.t = d.t AND e.user_id = d.user_id AND e.o > d.o
      GROUP BY r, d.t, d.user_id, d.o, d.value)
    SELECT 'dbo.users_' || t AS target_table, user_id, coalesce(latest, value) AS value FROM u
    """,
)
def rev6_fold_targets(spark, sf_dir):
    """Three targets after every event of the table was applied, each target by one write."""
    targets, _ = fold_queue(spark, sf_dir)
    out = None
    for name, target in targets.items():
        rows = target.read().select(F.lit(name).alias("target_table"), "user_id", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "rev6_fold_results",
    f"""
    WITH {FOLD_CTE},
    n AS (
      SELECT e.event_id, count(d.t) AS n FROM e LEFT JOIN d ON d.t = e.t AND d.user_id = e.user_id AND d.o < e.o
        AND (d.gone IS NULL OR e.o <= d.gone) GROUP BY e.event_id),
    r AS (
      SELECT e.event_id, op, CASE op WHEN 'INSERT' THEN 1 WHEN 'NONE' THEN 0 ELSE n END AS affected
      FROM e JOIN n USING (event_id))
    SELECT event_id, CASE WHEN op = 'NONE' THEN 'failed' ELSE 'completed' END AS status, affected AS rows_affected,
           CASE WHEN op = 'UPDATE' AND affected <> 1 THEN 1 - affected END AS discrepancy,
           CASE WHEN op = 'NONE' THEN 'unknown operation: NONE' END AS error_message FROM r
    """,
)
def rev6_fold_results(spark, sf_dir):
    """What each event of the table did, from the same aggregates."""
    _, results = fold_queue(spark, sf_dir)
    return results.select("event_id", "status", "rows_affected", "discrepancy", "error_message")


ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query(
    "agg2_prints_after_events",
    f"""
    WITH t AS ({UPDATED_SQL.format(extra="")} WHERE o_orderstatus <> 'P'),
    f AS ({prints_sql('t', 'o_orderstatus, o_orderpriority', ORDER_COLUMNS)})
    SELECT o_orderstatus AS level1_value, o_orderpriority AS level2_value, row_count, checksum_xor, checksum_sum
    FROM f
    """,
)
def agg2_after_events(spark, sf_dir):
    """Stored fingerprints, moved on by the rows that events changed; SQL counts all rows again."""
    desk, columns = Desk(spark, sf_dir), ORDER_COLUMNS.split(", ")
    store = FingerprintStore(spark, run_dir(spark, "moved-on"))
    target, keys, method = desk.target("dbo.orders"), ["level1_value", "level2_value"], {"method": "md5", "scale": SCALE}

    def sliced(rows):
        return rows.withColumns({"level1_value": F.col("o_orderstatus"), "level2_value": F.col("o_orderpriority")})

    store.save(fingerprint(sliced(target.read()), keys, columns, **method), "all", "orders", "product", made_by="md5")
    fold_events(
        desk.queue(INSERT, UPDATE, DELETE), NamedSources(desk.source), desk.target, None, clock=lambda: PROCESSED_AT,
        changed=lambda name, gone, came: store.move_on(
            change_prints(sliced(gone), sliced(came), keys, columns, **method), "all", "orders", "product", "md5"))
    return store.load("all", "orders", "product").select(
        *keys, "row_count", "checksum_xor", F.col("checksum_sum").cast("string").alias("checksum_sum"))


@query(
    "agg2_wrong_base",
    f"""
    WITH {PURCHASES_CTE}, f AS ({prints_sql('p', 'period, l_suppkey')})
    SELECT period AS level1_value, l_suppkey AS level2_value, 'changed' AS status, row_count,
           row_count + 1 AS stored_row_count
    FROM f WHERE l_suppkey % 50 = 7
    """,
)
def agg2_wrong_base(spark, sf_dir):
    """Fingerprints that were stored wrongly stay wrong by the same difference, and are found."""
    keys, columns = ["level1_value", "level2_value"], PURCHASE_COLUMNS.split(", ")
    rows = purchases(spark, sf_dir).withColumns({"level1_value": F.col("period"), "level2_value": F.col("l_suppkey")})
    late = F.col("period") >= 200101
    stored = fingerprint(rows.where(~late), keys, columns).withColumn(
        "row_count", F.col("row_count") + (F.col("level2_value") % 50 == 7).cast("int"))
    # Where the base has no such slice, the first rows bring the mistake.
    change = change_prints(rows.where("false"), rows.where(late), keys, columns)
    fresh = change.join(stored, keys, "left_anti").withColumn(
        "row_count", F.col("row_count") + (F.col("level2_value") % 50 == 7).cast("int"))
    change = change.join(stored, keys, "left_semi").unionByName(fresh)
    wrong = wrong_slices(moved_on(stored, change, keys), rows, keys, columns)
    return wrong.select(*keys, "status", "row_count", "stored_row_count")


DECISION_SQL = """
decided AS (
  SELECT event_id, target_table,
         coalesce(own.access, anywhere.access) IN ('write', 'read_write') AS granted,
         CASE WHEN own.table_name IS NOT NULL THEN own.cap ELSE anywhere.cap END AS delete_cap,
         rows_expected
  FROM r LEFT JOIN g own ON own.table_name = r.target_table AND own.user_name = r.user_name
  LEFT JOIN g anywhere ON anywhere.table_name = '*' AND anywhere.user_name = r.user_name)"""


@query(
    "rev7_permission_and_cap",
    f"""
    WITH {QUEUE_CTE}, {GRANTS_SQL}, {DECISION_SQL}
    SELECT event_id, CASE WHEN NOT granted THEN 'blocked'
                          WHEN delete_cap IS NOT NULL AND rows_expected > delete_cap THEN 'blocked'
                          ELSE 'allowed' END AS decision,
           CASE WHEN NOT granted THEN 'access denied'
                WHEN delete_cap IS NOT NULL AND rows_expected > delete_cap
                THEN 'delete limit exceeded' END AS reason
    FROM decided
    """,
)
def rev7(spark, sf_dir):
    return decide(permission_requests(spark, sf_dir), grants(spark), F.lit("write")).select(
        "event_id", "decision", "reason"
    )


# --- queue ----------------------------------------------------------------

@query(
    "evt1_create_events",
    """
    SELECT 'ev-' || event_id AS event_id, 'INSERT' AS operation, 'pending' AS status, 5 AS priority,
           0 AS retry_count, 3 AS max_retries, 0 AS key_count, '{"user":"' || user_id || '"}' AS metadata,
           TIMESTAMP '2024-01-31' AS created_at FROM events
    """,
)
def evt1(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(
        F.concat(F.lit("ev-"), "event_id").alias("event_id"),
        F.lit("INSERT").alias("operation"),
        F.lit("lake.sales.orders").alias("source_table"),
        F.lit("dbo.orders").alias("target_table"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"),
    )
    queue = VersionedTable(spark, run_dir(spark, "queue"))
    queue.append(E.new_events(requests, moment_literal(AS_OF_EVENTS)))
    return queue.read().select(
        "event_id", "operation", "status", "priority", "retry_count", "max_retries",
        F.size("primary_keys").alias("key_count"), "metadata", "created_at",
    )


@query(
    "evt2_list_events",
    f"""
    WITH {QUEUE_CTE}
    SELECT event_id, operation, status, created_at FROM q
    WHERE status = 'pending' AND operation = 'DELETE' ORDER BY created_at DESC, event_id LIMIT 100
    """,
)
def evt2(spark, sf_dir):
    found = E.list_events(queue_events(spark, sf_dir), "pending", "DELETE", 100)
    return found.select("event_id", "operation", "status", "created_at")


@query(
    "evt3_record_results",
    f"""
    WITH {QUEUE_CTE}
    SELECT event_id, CASE WHEN status <> 'pending' THEN status WHEN rows_expected >= 50
                          THEN 'failed' ELSE 'completed' END AS status,
           CASE WHEN status IN ('pending', 'completed') THEN rows_expected END AS rows_affected,
           CASE WHEN status <> 'pending' THEN error_message
                WHEN rows_expected >= 50 THEN 'too many' END AS error_message
    FROM q
    """,
)
def evt3(spark, sf_dir):
    queue = queue_events(spark, sf_dir)
    too_many = F.col("rows_expected") >= 50
    results = queue.where("status = 'pending'").select(
        "event_id",
        F.when(too_many, "failed").otherwise("completed").alias("status"),
        F.col("rows_expected").alias("rows_affected"),
        F.lit(None).cast("long").alias("discrepancy"),
        F.lit(None).cast("string").alias("warning"),
        F.when(too_many, "too many").alias("error_message"),
        moment_literal(PROCESSED_AT).alias("processed_at"),
    )
    return E.record_results(queue, results).select(
        "event_id", "status", "rows_affected", "error_message"
    )


@query(
    "evt4_retry_and_cancel",
    f"""
    WITH {QUEUE_CTE}
    SELECT event_id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status,
           CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS retry_count,
           CASE WHEN status <> 'failed' THEN error_message END AS error_message
    FROM q WHERE NOT (status = 'pending' AND operation = 'DELETE')
    """,
)
def evt4(spark, sf_dir):
    queue = E.cancel(queue_events(spark, sf_dir), F.col("operation") == "DELETE")
    return E.retry(queue, F.lit(True)).select(
        "event_id", "status", "retry_count", "error_message"
    )


@query(
    "evt5_purge",
    f"""
    WITH {QUEUE_CTE}
    SELECT event_id, status, created_at FROM q
    WHERE NOT (status IN ('completed', 'failed') AND created_at < TIMESTAMP '2024-01-24')
    """,
)
def evt5(spark, sf_dir):
    kept = E.purge(queue_events(spark, sf_dir), AS_OF_EVENTS, 7)
    return kept.select("event_id", "status", "created_at")


RESTARTED = "restarted before the job completed"


@query(
    "evt6_orphan_recovery",
    f"""
    WITH {JOBS_CTE}
    SELECT job_id, CASE WHEN status IN ('pending', 'running') THEN 'failed' ELSE status END AS status,
           CASE WHEN status IN ('pending', 'running') THEN '{RESTARTED}' END AS error FROM j
    """,
)
def evt6(spark, sf_dir):
    return E.fail_orphans(jobs(spark, sf_dir), RESTARTED).select("job_id", "status", "error")


# --- audit ----------------------------------------------------------------

def audit_events(spark, sf_dir) -> DataFrame:
    """One audit event per row of ``events``."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.col("ts").alias("event_time"),
        F.concat(F.lit("user-"), "user_id").alias("user_name"),
        F.concat_ws("-", F.lit("secret"), "user_id", "event_id").alias("token"),
        F.when(kind == "error", "auth_failure").when(kind == "purchase", "sync_failed")
        .when(kind == "signup", "delete_blocked").otherwise("sync_completed").alias("event_type"),
        F.when(kind == "view", "query").otherwise("write").alias("action"),
        F.struct(
            F.when(F.col("user_id") < 50, "first_share").otherwise("second_share")
            .alias("share_name"),
            kind.alias("table_name"),
        ).alias("request"),
    )


AUDIT_TYPE_SQL = """CASE event_type WHEN 'error' THEN 'auth_failure' WHEN 'purchase' THEN 'sync_failed'
                  WHEN 'signup' THEN 'delete_blocked' ELSE 'sync_completed' END"""


@query(
    "aud1_append_audit",
    f"""
    SELECT event_id, 'user-' || user_id AS user_name, {AUDIT_TYPE_SQL} AS event_type,
           substr('secret-' || user_id || '-' || event_id, 1, 8) || '...' AS user_token_prefix
    FROM events
    """,
)
def aud1(spark, sf_dir):
    log = VersionedTable(spark, run_dir(spark, "audit"))
    log.append(audit_rows(audit_events(spark, sf_dir)).drop("request"))
    return log.read().select("event_id", "user_name", "event_type", "user_token_prefix")


@query(
    "aud2_severity",
    f"""
    SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN 'warning'
                          WHEN event_type = 'purchase' THEN 'error' ELSE 'info' END AS severity
    FROM events
    """,
)
def aud2(spark, sf_dir):
    return audit_events(spark, sf_dir).select("event_id", severity("event_type").alias("severity"))


@query(
    "aud3_search",
    """
    SELECT event_id, ts AS event_time, 'user-' || user_id AS user_name FROM events
    WHERE event_type = 'view' AND user_id < 50 ORDER BY ts DESC, event_id LIMIT 100
    """,
)
def aud3(spark, sf_dir):
    return search(audit_events(spark, sf_dir), "query", "first_share", 100).select(
        "event_id", "event_time", "user_name"
    )


# --- streams --------------------------------------------------------------

@query(
    "str1_poll_and_apply",
    UPDATED_SQL.format(extra="") + " WHERE o_orderstatus <> 'P'",
)
def str1(spark, sf_dir):
    """Three events arrive as files, out of order, one of them twice."""
    desk = Desk(spark, sf_dir)
    landing, results = run_dir(spark, "landing"), VersionedTable(spark, run_dir(spark, "results"))
    queue = desk.queue(INSERT, UPDATE, DELETE)
    for event_id in ("e3", "e1", "e2", "e1"):
        queue.where(F.col("event_id") == event_id).coalesce(1).write.mode("append").parquet(landing)
    stream_apply(
        read_events(spark, landing), results, desk.applier(), run_dir(spark, "checkpoint")
    ).awaitTermination()
    return desk.target("dbo.orders").read()


@query(
    "str2_mark_status",
    f"""
    WITH {QUEUE_CTE}
    SELECT event_id, CASE WHEN operation = 'NONE' THEN 'failed' ELSE 'processing' END AS status,
           CASE WHEN operation = 'NONE' THEN 'unknown operation' END AS error_message FROM q
    """,
)
def str2(spark, sf_dir):
    landing, results = run_dir(spark, "landing"), run_dir(spark, "results")
    queue_events(spark, sf_dir).write.parquet(landing)
    stream_status(
        read_events(spark, landing), results, run_dir(spark, "checkpoint")
    ).awaitTermination()
    return spark.read.schema(
        "event_id string, status string, error_message string"
    ).parquet(results).select("event_id", "status", "error_message")
