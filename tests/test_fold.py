"""A whole queue at once gives what one event after the other gives."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from slicesync.functions.periods import moment_literal
from slicesync.operators import events as E
from slicesync.plans.fold import NamedSources, RowSource, fold_events
from slicesync.plans.reverse import EventApplier, apply_events
from slicesync.sources.versions import VersionedTable

NOW = datetime(2024, 1, 1)
SCHEMA = "id int, name string, value double"


class World:
    def __init__(self, spark, folder, partition_by=None, rows=()):
        self.spark, self.folder, self.partition_by = spark, folder, partition_by
        self.rows, self.sources = list(rows), {}

    def source(self, name, rows, schema=SCHEMA):
        self.sources[name] = self.spark.createDataFrame(list(rows), schema)

    def targets(self, label):
        made = {}

        def open_target(name):
            if name not in made:
                made[name] = VersionedTable(self.spark, f"{self.folder}/{label}/{name}", partition_by=self.partition_by)
                if self.rows:
                    made[name].overwrite(self.spark.createDataFrame(self.rows, SCHEMA))
            return made[name]

        return made, open_target

    def queue(self, events):
        rows = []
        for i, event in enumerate(events, 1):
            conditions = event.get("conditions")
            rows.append((
                f"e{i:05d}", event["operation"], event.get("source", "c.s.t"), event.get("target", "dbo.people"),
                event.get("keys", ["id"]), event.get("priority", 10_000 - i), event.get("expected"),
                conditions if conditions is None or isinstance(conditions, str) else json.dumps(conditions)))
        requests = self.spark.createDataFrame(
            rows, "event_id string, operation string, source_table string, target_table string, "
            "primary_keys array<string>, priority int, rows_expected long, filter_conditions string")
        return E.new_events(requests, moment_literal(NOW))

    def both(self, events, cap=10, sources=None):
        """Results and rows of each way."""
        queue, out = self.queue(events).cache(), []
        for label in ("one", "all"):
            made, open_target = self.targets(label)
            if label == "one":
                applier = EventApplier(lambda name: self.sources[name], open_target, cap, clock=lambda: NOW)
                results = apply_events(queue, applier)
            else:
                results = fold_events(
                    queue, sources or NamedSources(lambda name: self.sources[name]), open_target, cap, clock=lambda: NOW)
            rows = {name: sorted(map(tuple, t.read().select("id", "name", "value").collect()), key=repr) if t.exists() else None
                    for name, t in made.items()}
            said = [tuple(x.replace(f"/{label}/", "/") if isinstance(x, str) else x for x in r) for r in results.collect()]
            out.append((sorted(said, key=repr), rows))
        return out

    def agree(self, events, **options):
        one, all_at_once = self.both(events, **options)
        for a, b in zip(one[0], all_at_once[0]):
            assert a == b
        assert len(one[0]) == len(all_at_once[0]) and one[1] == all_at_once[1]
        return {r[0]: r for r in one[0]}


PEOPLE = [(1, "Alice", 100.0), (2, "Bob", 200.0), (3, "Charlie", 300.0), (None, None, None), (3, "Twin", 300.0)]


@pytest.fixture(params=[None, "name"])
def world(spark, folder, request):
    return World(spark, folder, request.param, PEOPLE)


def test_each_kind_of_event(world):
    world.source("c.s.t", [(4, "Dan", 1.0), (5, "Eve", 2.0), (5, "Eve", 2.0)])
    world.source("c.s.values", [(4, None), (3, 9.0), (99, 1.0)], "id int, value double")
    world.source("c.s.keys", [(1,)], "id int")
    world.source("c.s.none", [], SCHEMA)
    world.source("c.s.twice", [(1, "x", 1.0), (1, "y", 1.0)])
    world.source("c.s.strange", [(1, 2)], "id int, other int")
    world.source("c.s.far", [(77, 2)], "id int, other int")
    world.source("c.s.moved", [(2, "Alice", 5.0), (None, "nobody", 1.0)])
    update = {"operation": "UPDATE"}
    world.agree([
        {"operation": "DELETE", "conditions": {"id": 4}},
        {"operation": "INSERT", "expected": 5}, {"operation": "INSERT", "keys": [], "source": "c.s.t"},
        {**update, "source": "c.s.values"}, {**update, "source": "c.s.keys"}, {**update, "source": "c.s.none"},
        {**update, "source": "c.s.twice"}, {**update, "source": "c.s.strange"}, {**update, "source": "c.s.far"},
        {**update, "source": "c.s.moved", "expected": 0}, {**update, "keys": []}, {**update, "keys": ["nokey"]},
        {"operation": "INSERT", "source": "c.s.strange"}, {"operation": "INSERT", "source": "c.s.none"},
        {"operation": "INSERT", "source": "c.s.lost"}, {"operation": "INSERT", "source": "lost"},
        {"operation": "INSERT", "target": "a.b.c"}, {"operation": "MERGE"}, {"operation": "INSERT", "keys": ["zip"]},
        {"operation": "DELETE", "conditions": {"name": "Alice", "id": 2}}, {"operation": "DELETE", "conditions": {"value": 9}},
        {"operation": "DELETE", "conditions": {"id": None}}, {"operation": "DELETE", "conditions": {}},
        {"operation": "DELETE", "conditions": None}, {"operation": "DELETE", "conditions": "{broken"},
        {"operation": "DELETE", "conditions": "[1]"}, {"operation": "DELETE", "conditions": {"zip": 1, "id": 1}},
        {"operation": "DELETE", "conditions": {"name": "Eve"}, "expected": 1},
        {"operation": "INSERT", "source": "c.s.values"}, {"operation": "DELETE", "conditions": {"name": "Eve"}},
    ])


def test_caps_are_settled_in_order(world):
    world.source("c.s.t", [(i, "Many", float(i % 2)) for i in range(10, 16)])
    done = world.agree([
        {"operation": "INSERT"}, {"operation": "DELETE", "conditions": {"name": "Many"}},
        {"operation": "DELETE", "conditions": {"value": 0}}, {"operation": "INSERT"},
        {"operation": "DELETE", "conditions": {"value": 0}}, {"operation": "DELETE", "conditions": {"name": "Many"}},
        {"operation": "DELETE", "conditions": {"value": 1}}, {"operation": "DELETE", "conditions": {"id": 3}},
    ], cap=3)
    assert [r[1] for _, r in sorted(done.items())] == [
        "completed", "failed", "completed", "completed", "completed", "failed", "failed", "completed"]


def test_a_target_that_an_insert_makes(world):
    world.rows = []
    world.source("c.s.t", [(1, "a", 1.0), (2, "b", 2.0)])
    world.source("c.s.none", [])
    world.agree([
        {"operation": "UPDATE"}, {"operation": "DELETE", "conditions": {"id": 1}},
        {"operation": "INSERT", "source": "c.s.none"}, {"operation": "INSERT"}, {"operation": "UPDATE"},
        {"operation": "DELETE", "conditions": {"id": 1}}, {"operation": "UPDATE", "target": "dbo.never"},
    ])


def test_updates_that_change_other_updates_keys(world):
    world.source("c.s.t", [(1, "Bob", 1.0)])
    world.source("c.s.names", [("Bob", 7.0), ("Alice", 8.0)], "name string, value double")
    world.agree([
        {"operation": "UPDATE"}, {"operation": "UPDATE", "source": "c.s.names", "keys": ["name"]},
        {"operation": "UPDATE"}, {"operation": "DELETE", "conditions": {"value": 7}}])


@pytest.mark.parametrize("seed", range(1))
def test_random_queues(world, seed):
    source = random.Random(seed)
    names = ["a", "b", None]
    for k in range(4):
        ids = source.sample(range(6), source.randrange(1, 4))
        world.source(f"c.s.t{k}", [(i, source.choice(names), float(source.randrange(3))) for i in ids])
        world.source(f"c.s.v{k}", [(i, float(source.randrange(3))) for i in ids], "id int, value double")
    events = []
    for _ in range(14):
        k, target = source.randrange(4), source.choice(["dbo.people", "dbo.others"])
        kind = source.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"])
        event = {"operation": kind, "target": target, "expected": source.choice([None, 1]),
                 "source": f"c.s.{source.choice('tv') if kind == 'UPDATE' else 't'}{k}"}
        if kind == "DELETE":
            event["conditions"] = source.choice([
                {"id": source.randrange(6)}, {"value": source.randrange(3)}, {"name": "a"},
                {"id": source.randrange(6), "value": source.randrange(3)}])
        events.append(event)
    world.agree(events, cap=source.choice([1, 3]))


def test_permission_and_own_caps(spark, folder):
    world = World(spark, folder, None, PEOPLE)
    _, open_target = world.targets("x")
    events = world.queue([
        {"operation": "DELETE", "conditions": {"id": 3}}, {"operation": "DELETE", "conditions": {"id": 3}},
        {"operation": "DELETE", "conditions": {"id": 1}}])
    number = F.substring("event_id", -1, 1).cast("int")
    results = fold_events(
        events, NamedSources(world.sources.get), open_target, None, clock=lambda: NOW,
        delete_cap=F.when(number == 1, 1), allowed=number < 3).collect()
    assert {r.event_id[-1]: (r.status, r.rows_affected, r.error_message) for r in results} == {
        "1": ("failed", 0, "delete limit exceeded: 2 > 1"), "2": ("completed", 2, None),
        "3": ("blocked", 0, "write access denied")}


def jobs_of(spark, label, work):
    spark.sparkContext.setJobGroup(label, label)
    work()
    spark.sparkContext._jsc.clearJobGroup()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(label))


def test_jobs_do_not_grow_with_events(spark, folder):
    """Each event has rows of its own, in one relation of all sources."""
    counts = {}
    for n in (30, 3000):
        rows = spark.range(n).selectExpr(
            "concat('c.s.t', id) AS source_table", "cast(id % 400 AS int) AS id", "concat('n', id % 7) AS name", "id * 1.0D AS value")
        world = World(spark, f"{folder}/{n}", None, [(i, "old", 0.0) for i in range(100)])
        queue = world.queue([
            {"operation": ("INSERT", "UPDATE", "UPDATE", "DELETE")[i % 4], "source": f"c.s.t{i}",
             "target": f"dbo.t{i % 3}", "conditions": {"id": i % 100} if i % 4 == 3 else None} for i in range(n)]).cache()
        queue.count()
        made, open_target = world.targets("all")
        for k in range(3):
            open_target(f"dbo.t{k}")
        counts[n] = jobs_of(spark, f"fold-{n}", lambda: fold_events(
            queue, RowSource(rows, "source_table"), open_target, clock=lambda: NOW))
    assert 0 < counts[3000] <= counts[30] + 20
