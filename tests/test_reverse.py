"""Insert, update and delete events against a target, one row per event."""

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from slicesync.functions.periods import moment_literal
from slicesync.operators import apply as A
from slicesync.operators import events as E
from slicesync.operators.audit import severity, token_prefix
from slicesync.operators.permissions import PERMISSION_SCHEMA, accessible_tables, decide
from slicesync.plans.reverse import EventApplier, apply_events
from slicesync.sources.versions import VersionedTable
from slicesync.streaming.event_stream import once, read_events, stream_apply

NOW = datetime(2024, 1, 1)
PEOPLE = [(1, "Alice", 100.0), (2, "Bob", 200.0), (3, "Charlie", 300.0)]
SCHEMA = "id int, name string, value double"


class World:
    def __init__(self, spark, folder, partition_by=None):
        self.spark, self.folder = spark, folder
        self.sources = {}
        self.target = VersionedTable(spark, f"{folder}/target", partition_by=partition_by)
        self.target.overwrite(spark.createDataFrame(PEOPLE, SCHEMA))

    def run(self, *events, **options):
        options = {"max_delete_rows": 10, "clock": lambda: NOW, **options}
        applier = EventApplier(lambda name: self.sources[name], lambda name: self.target, **options)
        return {r["event_id"]: r for r in apply_events(self.queue(*events), applier).collect()}

    def queue(self, *events):
        rows = []
        for i, event in enumerate(events, 1):
            conditions = event.get("filter_conditions")
            rows.append((
                f"e{i}", event["operation"], event.get("source_table", "c.s.t"),
                event.get("target_table", "dbo.people"), event.get("primary_keys", ["id"]),
                event.get("priority", 100 - i), event.get("rows_expected"),
                json.dumps(conditions) if isinstance(conditions, dict) else conditions,
            ))
        requests = self.spark.createDataFrame(
            rows, "event_id string, operation string, source_table string, target_table string, "
            "primary_keys array<string>, priority int, rows_expected long, "
            "filter_conditions string")
        return E.new_events(requests, moment_literal(NOW))

    def source(self, *rows, schema=SCHEMA):
        self.sources["c.s.t"] = self.spark.createDataFrame(list(rows), schema)

    def rows(self):
        return sorted(map(tuple, self.target.read().select("id", "name", "value").collect()))


@pytest.fixture(params=[None, "name"])
def world(spark, folder, request):
    return World(spark, folder, request.param)


def test_insert_counts_and_warns_of_duplicates(world):
    world.source((4, "Dan", 1.0), (5, "Eve", 2.0), (5, "Eve", 2.0))
    done = world.run({"operation": "INSERT", "rows_expected": 5})["e1"]
    assert (done["status"], done["rows_affected"], done["discrepancy"]) == ("completed", 3, 2)
    assert "1 duplicate" in done["warning"]
    assert len(world.rows()) == 6


def test_update_sets_null_and_ignores_unknown_keys(world):
    world.source((2, None), (9, 5.0), schema="id int, value double")
    done = world.run({"operation": "UPDATE"})["e1"]
    assert (done["status"], done["rows_affected"], done["discrepancy"]) == ("completed", 1, 1)
    assert sorted(world.rows(), key=repr) == sorted(
        [(1, "Alice", 100.0), (2, "Bob", None), (3, "Charlie", 300.0)], key=repr)


def test_update_may_move_a_row_to_another_part(world):
    world.source((1, "Bob", 1.0))
    world.run({"operation": "UPDATE"})
    assert world.rows() == [(1, "Bob", 1.0), (2, "Bob", 200.0), (3, "Charlie", 300.0)]


def test_update_with_duplicate_keys_or_keys_only(world):
    world.source((2, "x", 1.0), (2, "y", 1.0))
    assert world.run({"operation": "UPDATE"})["e1"]["status"] == "failed"
    world.source((2,), schema="id int")
    assert world.run({"operation": "UPDATE"})["e1"]["rows_affected"] == 0
    assert world.rows() == PEOPLE


def test_delete_with_cap_and_conditions(world):
    over = world.run({"operation": "DELETE", "filter_conditions": {"name": "Bob"}},
                     max_delete_rows=0)["e1"]
    assert over["status"] == "failed" and "delete limit exceeded: 1 > 0" in over["error_message"]
    none = world.run({"operation": "DELETE", "filter_conditions": {}})["e1"]
    assert none["status"] == "failed" and world.rows() == PEOPLE
    done = world.run({"operation": "DELETE", "filter_conditions": {"id": 1, "name": "Alice"},
                      "rows_expected": 0})["e1"]
    assert (done["rows_affected"], done["discrepancy"]) == (1, -1)
    assert world.rows() == PEOPLE[1:]


def test_events_run_in_queue_order_and_fail_alone(world):
    world.source((4, "Dan", 1.0))
    results = world.run(
        {"operation": "DELETE", "filter_conditions": {"id": 4}, "priority": 1},
        {"operation": "DELETE", "filter_conditions": "{broken", "priority": 9},
        {"operation": "INSERT", "priority": 5},
        {"operation": "INSERT", "source_table": "t", "priority": 4},
        {"operation": "INSERT", "target_table": "a.b.c", "priority": 4},
    )
    assert {k: r["status"] for k, r in results.items()} == {
        "e1": "completed", "e2": "failed", "e3": "completed", "e4": "failed", "e5": "failed"}
    assert results["e1"]["rows_affected"] == 1 and world.rows() == PEOPLE


def test_blocked_event(world):
    world.source((4, "Dan", 1.0))
    done = world.run({"operation": "INSERT"}, allowed=lambda event: False)["e1"]
    assert done["status"] == "blocked" and world.rows() == PEOPLE


def test_stream_applies_each_event_once(spark, world, folder):
    world.source((4, "Dan", 1.0))
    queue = world.queue({"operation": "INSERT"})
    landing, results = f"{folder}/landing", VersionedTable(spark, f"{folder}/results")
    applier = EventApplier(lambda name: world.sources[name], lambda name: world.target)
    for _ in range(2):  # the same event delivered twice, in two runs
        queue.write.mode("append").parquet(landing)
        stream_apply(read_events(spark, landing), results, applier,
                     f"{folder}/checkpoint").awaitTermination()
    assert len(world.rows()) == 4 and results.read().count() == 1


def test_a_committed_batch_is_not_applied_again(spark, folder):
    """The results' history names the batch; no result row is read for that."""
    world = World(spark, folder)
    world.source((4, "Dan", 1.0))
    world.queue({"operation": "INSERT"}).write.parquet(f"{folder}/landing")
    results = VersionedTable(spark, f"{folder}/results")
    results.read = None  # would fail
    applier = EventApplier(lambda name: world.sources[name], lambda name: world.target)
    stream_apply(read_events(spark, f"{folder}/landing"), results, applier, f"{folder}/c").awaitTermination()
    world.queue({"operation": "INSERT"}).withColumn("event_id", F.lit("e2")).write.mode("append").parquet(f"{folder}/landing")
    for batch in range(1, 5):  # as if it had run
        results.append(results.spark.createDataFrame([], results.schema()), job_id=f"{folder}/c#{batch}")
    stream_apply(read_events(spark, f"{folder}/landing"), results, applier, f"{folder}/c").awaitTermination()
    assert len(world.rows()) == 4


def test_stream_state_ends_with_the_horizon(spark, folder):
    """What the state holds is bounded by the horizon: old ids go, late events never do."""
    schema = spark.createDataFrame([], E.EVENT_SCHEMA).schema
    seen = []
    for k in range(4):
        row = spark.range(1).select(*(
            (F.lit(f"e{k // 2}") if f.name == "event_id" else F.lit("pending") if f.name == "status" else F.lit(None))
            .cast(f.dataType).alias(f.name) for f in schema))
        row.write.mode("append").parquet(f"{folder}/in")
        query = once(read_events(spark, f"{folder}/in"), "2 seconds").writeStream.foreachBatch(
            lambda batch, _: seen.extend(r.event_id for r in batch.collect())).option(
            "checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert held <= 1
        if k == 1:
            time.sleep(3)
    assert seen == ["e0", "e1"]


def test_queue_rules(spark):
    queue = spark.createDataFrame(
        [("a", "DELETE", ["id"], "{}", "pending", 0), ("b", "UPDATE", [], None, "failed", 0),
         ("c", "INSERT", [], None, "completed", 0), ("d", "DELETE", ["id"], '{"x": 1}', "blocked", 1)],
        "event_id string, operation string, primary_keys array<string>, "
        "filter_conditions string, status string, retry_count int"
    ).withColumns({"error_message": F.lit("e"), "warning": F.lit("w")})
    problems = {r[0]: r[1] for r in queue.select("event_id", E.request_problem()).collect()}
    assert problems == {"a": "conditions are required", "b": "primary keys are required",
                        "c": None, "d": None}
    again = {r["event_id"]: (r["status"], r["retry_count"], r["error_message"])
             for r in E.retry(queue, F.lit(True)).collect()}
    assert again == {"a": ("pending", 0, "e"), "b": ("pending", 1, None),
                     "c": ("completed", 0, "e"), "d": ("pending", 2, None)}
    assert {r[0] for r in E.cancel(queue, F.lit(True)).select("event_id").collect()} == {
        "b", "c", "d"}


def test_one_broken_condition_text_fails_alone(spark):
    texts = [('{"a": 1}',), ("{broken",), (None,), ("[1]",)]
    df = spark.createDataFrame(texts, "filter_conditions string")
    problems = [r[0] is None for r in df.select(E.conditions_problem()).collect()]
    assert problems == [True, False, True, False]


def test_permissions(spark):
    grants = spark.createDataFrame(
        [("u", "t1", "read", None), ("u", "t2", "write", 5), ("u", "*", "read_write", 1),
         ("v", "t1", "read_write", None)], PERMISSION_SCHEMA)
    asked = spark.createDataFrame(
        [("u", "t1", "write", 1), ("u", "t2", "write", 5), ("u", "t2", "write", 6),
         ("u", "t9", "read_write", 1), ("u", "t9", "write", 2), ("w", "t1", "read", 0),
         ("v", "t1", "read_write", 10**6)],
        "user_name string, table_name string, access string, delete_rows long")
    got = [(r["table_name"], r["delete_rows"], r["decision"])
           for r in decide(asked, grants).collect()]
    assert sorted(got) == sorted([
        ("t1", 1, "blocked"), ("t2", 5, "allowed"), ("t2", 6, "blocked"), ("t9", 1, "allowed"),
        ("t9", 2, "blocked"), ("t1", 0, "blocked"), ("t1", 10**6, "allowed")])
    assert {r[0] for r in accessible_tables(grants, "u", "write").collect()} == {"t2", "*"}


def test_names_and_audit(spark):
    assert A.split_target("people") == ("dbo", "people")
    for name in ("a.b.c", "", "a."):
        with pytest.raises(A.ApplyError):
            A.split_target(name)
    with pytest.raises(A.ApplyError):
        A.split_source("s.t")
    df = spark.createDataFrame(
        [("permission_denied", "0123456789"), ("sync_failed", ""), ("sync_started", None)],
        "event_type string, token string")
    assert [tuple(r) for r in df.select(severity("event_type"), token_prefix("token")).collect()] == [
        ("warning", "01234567..."), ("error", None), ("info", None)]


def test_retry_stops_at_the_limit(spark):
    queue = spark.createDataFrame(
        [("a", "failed", 2, 3), ("b", "failed", 3, 3), ("c", "failed", 9, None)],
        "event_id string, status string, retry_count int, max_retries int",
    ).selectExpr("*", "'x' AS error_message", "'y' AS warning")
    got = {r["event_id"]: r["status"] for r in E.retry(queue, F.lit(True)).collect()}
    assert got == {"a": "pending", "b": "failed", "c": "pending"}
