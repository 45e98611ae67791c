"""Apply a whole queue of events at once: joins and aggregates in place of one run per event.

The outcome is what ``EventApplier`` gives one event after the other, in queue order. Rows of
the target that an update's key or a delete's conditions can meet, and all rows that events
insert, become instances with the order they were born at. An instance and the updates of its
key give its versions, each valid from one event to the next. A delete meets the versions that
are valid at its order, and the first that does ends the instance. So every event's count, and
with it caps and discrepancies, come from aggregates, and each target is written once for a
run of events. The number of Spark jobs depends on targets, sources and the sets of columns
that conditions name, not on events.

A run ends where updates of a target change their key columns, as such an update may move what
another's key means. Deletes beyond their cap have no effect; refusing one can only leave more
rows for later ones, so refusals are settled in rounds until no more follow. If a write fails,
all events of its run fail.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicesync.functions.periods import moment_literal, now_utc
from slicesync.operators.events import queue_order
from slicesync.plans.reverse import DEFAULT_MAX_DELETE_ROWS, RESULT_SCHEMA, EventApplier, apply_events
from slicesync.session import local_rows, stage
from slicesync.sources.versions import VersionedTable

SOURCE = "_source"


@dataclass
class SourceGroup:
    """Rows of sources with the same columns; ``_source`` says which one's they are. ``name`` is
    the only one's, or None if the rows are those of all sources."""

    name: str | None
    columns: list[str]
    rows: DataFrame


class NamedSources:
    """Sources that are read by name, one relation for each distinct name."""

    def __init__(self, read_source: Callable[[str], DataFrame]):
        self.read_source = read_source

    def groups(self, names: DataFrame) -> tuple[list[SourceGroup], dict[str, str]]:
        """The sources, and what is wrong with those that can't be read."""
        found, errors = [], {}
        for name in [row[0] for row in names.distinct().collect()]:
            try:
                rows = self.read_source(name)
                found.append(SourceGroup(name, list(rows.columns), rows.withColumn(SOURCE, F.lit(name))))
            except Exception as error:  # only the events of this source fail
                errors[name] = str(error).split("\n")[0]
        return found, errors


class RowSource:
    """Rows of any number of sources in one relation, told apart by a column."""

    def __init__(self, rows: DataFrame, name_col: str):
        self.group = SourceGroup(
            None, [c for c in rows.columns if c != name_col], rows.withColumnRenamed(name_col, SOURCE))

    def groups(self, names: DataFrame) -> tuple[list[SourceGroup], dict[str, str]]:
        return [self.group], {}


def fold_events(
    events: DataFrame, sources: NamedSources | RowSource, open_target: Callable[[str], VersionedTable],
    max_delete_rows: int | None = DEFAULT_MAX_DELETE_ROWS, delete_cap: Column | None = None,
    allowed: Column | None = None, clock: Callable[[], datetime] = now_utc,
    changed: Callable[[str, DataFrame, DataFrame], None] | None = None,
) -> DataFrame:
    """Apply all events; one result row each, written and read back. ``delete_cap`` and ``allowed``
    are expressions over an event; a cap of NULL means ``max_delete_rows``. ``changed`` gets each
    written target's name, the rows that went and those that came, e.g. to move fingerprints on."""
    cap = F.lit(max_delete_rows).cast("long")
    if delete_cap is not None:
        cap = F.coalesce(delete_cap.cast("long"), cap)
    order = queue_order()
    # Ranges are in order, and so are numbers within them.
    headers = events.select(
        "event_id", "operation", "source_table", "target_table",
        F.coalesce("primary_keys", F.array().cast("array<string>")).alias("keys"),
        F.col("rows_expected").cast("long").alias("expected"), "filter_conditions", "priority", "created_at",
        cap.alias("cap"), (F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))).alias("allowed"),
    ).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = headers.withColumn("order", F.monotonically_increasing_id() + 1)
    queue = stage(ordered.withColumn("problem", _header_problem()), "queue")

    good = queue.where("allowed AND problem IS NULL")
    outcomes = [_failed(queue.where("NOT allowed OR problem IS NOT NULL").withColumn("error", F.col("problem")))]
    for name in [row[0] for row in good.select("target_table").distinct().collect()]:
        own = good.where(F.col("target_table") == name)
        for run in _runs(own):
            outcomes.append(_Run(run, sources, open_target(name), changed and partial(changed, name)).apply())
    return stage(_results(queue, _union(outcomes), clock()), "results")


def apply_all(events: DataFrame, applier: EventApplier) -> DataFrame:
    """What ``apply_events`` gives. An applier that asks Python for permissions or caps, event by
    event, can only do so one event after the other."""
    if applier.allowed is not None or applier.delete_cap_of is not None:
        return apply_events(events, applier)
    return fold_events(
        events, NamedSources(applier.read_source), applier.open_target, applier.max_delete_rows, clock=applier.clock)


def _header_problem() -> Column:
    """What is wrong with an event by its header alone."""
    operation, keyless = F.col("operation"), F.size("keys") == 0

    def malformed(name: str, least: int, most: int) -> Column:
        parts = F.split(F.col(name), "\\.")
        return F.coalesce(
            (F.size(parts) < least) | (F.size(parts) > most) | F.array_contains(parts, ""), F.lit(True))

    def says(text: str, name: str) -> Column:
        return F.concat(F.lit(f"{text}: '"), F.coalesce(F.col(name), F.lit("")), F.lit("'"))

    return (
        F.when(operation.isin("UPDATE", "DELETE") & keyless, F.concat(F.lit("primary keys are required for "), operation))
        .when(~F.coalesce(operation.isin("INSERT", "UPDATE", "DELETE"), F.lit(False)),
              F.concat(F.lit("unknown operation: "), F.coalesce(operation, F.lit("None"))))
        .when(malformed("target_table", 1, 2), says("target must be table or schema.table", "target_table"))
        .when((operation != "DELETE") & malformed("source_table", 3, 3),
              says("source must be catalog.schema.table", "source_table")))


def _runs(events: DataFrame) -> list[DataFrame]:
    """The events of one target, cut where updates change their key columns."""
    updates = events.where("operation = 'UPDATE'")
    if updates.select("keys").distinct().limit(2).count() < 2:
        return [events]
    before = F.lag("keys").over(Window.partitionBy("target_table").orderBy("order"))
    cuts = [r[0] for r in updates.select("order", (F.col("keys") != before).alias("cut")).where("cut")
            .orderBy("order").select("order").collect()]
    bounds = [0, *cuts, 1 << 62]
    return [events.where(F.col("order").between(a, b - 1)) for a, b in zip(bounds[:-1], bounds[1:])]


OUTCOME = "order long, found long, affected long, warning string, error string"


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _comparable(column: Column, kind: T.DataType) -> Column:
    """A column or a condition's text as something that tells equal values; NULL if it is none."""
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return column.try_cast("decimal(38,18)")
    if isinstance(kind, T.FractionalType):
        return column.try_cast("double")
    return column.try_cast(kind)


class _Run:
    """Events of one target that are applied by one write."""

    def __init__(self, events: DataFrame, sources, target: VersionedTable, changed=None):
        self.events, self.target, self.spark, self.changed = events, target, events.sparkSession, changed
        loads = events.where("operation <> 'DELETE'")
        self.groups, unread = sources.groups(loads.select("source_table"))
        unread_rows = local_rows(self.spark, list(unread.items()), "name string, error string")
        self.unread = loads.join(unread_rows, F.col("source_table") == F.col("name")).select("order", "error")
        empty = loads.where("false").select(
            "order", "operation", "source_table", "keys", F.lit(0).alias("group"), F.lit(0).cast("long").alias("found"),
            F.lit(0).cast("long").alias("excess"), F.lit("").alias("missing"), F.lit(False).alias("only_keys"))
        self.loads = stage(_union([empty, *(x for i in range(len(self.groups)) for x in self._facts(loads, i))]), "loads")

    def _facts(self, loads: DataFrame, number: int) -> list[DataFrame]:
        """Each insert and update of a group with its source's rows and what is wrong with its
        keys: one relation for each set of key columns."""
        group = self.groups[number]
        own = loads if group.name is None else loads.where(F.col("source_table") == group.name)
        counts = group.rows.groupBy(SOURCE).agg(F.count(F.lit(1)).alias("found"))
        out = []
        for keys in [row[0] for row in own.select("keys").distinct().collect()]:
            missing = [k for k in keys if k not in group.columns]
            facts = counts.withColumn("excess", F.lit(0).cast("long"))
            if keys and not missing:
                facts = group.rows.groupBy(SOURCE, *keys).agg(F.count(F.lit(1)).alias("_n")).groupBy(SOURCE).agg(
                    F.sum("_n").alias("found"), F.sum(F.col("_n") - 1).alias("excess"))
            out.append(
                own.where(F.col("keys") == F.array(*map(F.lit, keys)).cast("array<string>"))
                .join(facts, F.col("source_table") == F.col(SOURCE), "left").select(
                    "order", "operation", "source_table", "keys", F.lit(number).alias("group"),
                    F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("excess", F.lit(0)).alias("excess"),
                    F.lit(", ".join(missing)).alias("missing"),
                    F.lit(set(group.columns) == set(keys)).alias("only_keys")))
        return out

    def apply(self) -> DataFrame:
        """The events' outcomes, after the target is written."""
        if self.target.exists():
            return self._fold(self.target.schema(), None)
        first = self.loads.where("operation = 'INSERT' AND found > 0 AND missing = ''").orderBy("order").first()
        nowhere = f"no table at {self.target.path}"
        if first is None:
            loads = self._load_outcomes(F.lit(nowhere))
            gone = self.events.where("operation = 'DELETE'").select("order", F.lit(nowhere).alias("error"))
            return _union([loads, _failed(gone)])
        schema = T.StructType([
            T.StructField(f.name.lower(), f.dataType) for f in self.groups[first["group"]].rows.schema if f.name != SOURCE])
        return self._fold(schema, first["order"])

    def _load_outcomes(self, no_update: Column, affected: DataFrame | None = None, unknown: dict | None = None) -> DataFrame:
        """Outcomes of inserts and updates. ``affected``: rows that updates met; ``unknown``: text of
        each group's columns that the target does not have."""
        strange = F.lit("")
        for number, text in (unknown or {}).items():
            strange = F.when(F.col("group") == number, text).otherwise(strange)
        rows = self.loads.withColumn("strange", strange)
        rows = rows.withColumn("hits", F.lit(None).cast("long")) if affected is None else rows.join(
            affected.select("order", F.col("n").alias("hits")), "order", "left")
        insert, hits = F.col("operation") == "INSERT", F.coalesce("hits", F.lit(0))
        error = (
            F.when((F.col("found") > 0) & insert & (F.col("missing") != ""), _said("missing primary key columns: ", F.col("missing")))
            .when(~insert & (F.col("missing") != ""), _said("missing primary key columns: ", F.col("missing")))
            .when(F.col("found") == 0, None)
            .when(insert & (F.col("strange") != ""), _said("unknown columns: ", F.col("strange")))
            .when(insert | F.col("only_keys"), None)
            .when(F.col("excess") > 0, "duplicate primary keys in the source of an update")
            .when(no_update.isNotNull(), no_update)
            .when((F.col("strange") != "") & (hits > 0), _said("unknown columns: ", F.col("strange"))))
        warning = (
            F.when(F.col("found") == 0, _said("no data to ", F.lower("operation")))
            .when(insert & (F.col("excess") > 0), _said("found ", F.col("excess"), " duplicate primary key rows"))
            .when(~insert & F.col("only_keys"), "no columns to set"))
        rows = rows.withColumn("error", error)
        done = rows.select(
            "order", F.col("found"), F.when(F.col("error").isNotNull(), 0).when(insert, F.col("found")).otherwise(hits)
            .cast("long").alias("affected"), F.when(F.col("error").isNull(), warning).alias("warning"), "error")
        return done.unionByName(_failed(self.unread))

    # --- the fold ---------------------------------------------------------

    def _fold(self, schema: T.StructType, born: int | None) -> DataFrame:
        """Outcomes, with the target written. ``born``: the insert that makes the target."""
        names = schema.names
        unknown = {i: ", ".join(c for c in g.columns if c not in names) for i, g in enumerate(self.groups)}
        strange = [i for i, text in unknown.items() if text]
        key_rows = self.loads.where("operation = 'UPDATE'").select("keys").distinct().collect()
        keys = next((row[0] for row in key_rows if all(k in names for k in row[0])), None)
        early = F.lit(False) if born is None else F.col("order") < born
        updates, inserted = self._effects(schema, keys, strange, early)
        deletes, wrong = self._deletes(schema, early)

        touched = self._touched(schema, keys, updates, deletes) if born is None else None
        instances = inserted if touched is None else touched.where("_touched").select(
            F.lit(0).cast("long").alias("born"), *names).unionByName(inserted)
        instances = stage(instances.withColumn("iid", F.monotonically_increasing_id()), "instances")
        versions, met = self._versions(schema, keys, instances, updates)
        ends, refused = self._ends(schema, versions, deletes)

        alive = F.col("end").isNull() | (F.col("order") < F.col("end"))
        hits = met.join(ends, "iid", "left").where(alive).groupBy("order").agg(F.count(F.lit(1)).alias("n"))
        killed = ends.groupBy(F.col("end").alias("order")).agg(F.count(F.lit(1)).alias("n"))
        nowhere = F.when(early, f"no table at {self.target.path}") if born is not None else F.lit(None).cast("string")
        loads = self._load_outcomes(nowhere, hits, unknown)
        dropped = self.events.where("operation = 'DELETE'").select("order").join(killed, "order", "left").join(
            wrong.unionByName(refused), "order", "left")
        if born is not None:
            dropped = dropped.withColumn("error", F.coalesce(nowhere, F.col("error")))
        count = F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("long")
        dropped = dropped.select(
            "order", count.alias("found"), count.alias("affected"), F.lit(None).cast("string").alias("warning"), "error")
        outcome = stage(loads.unionByName(dropped), "outcomes")
        try:
            self._write(schema, touched, versions, met, ends)
            if self.changed is not None:
                self.changed(*self._change(schema, versions, met, ends))
        except Exception as error:  # the other targets go on
            said = str(error).split("\n")[0]
            return outcome.withColumn("error", F.coalesce("error", F.lit(said))).withColumn("affected", F.lit(0).cast("long"))
        return outcome

    def _effects(self, schema, keys, strange, early) -> tuple[DataFrame, DataFrame | None]:
        """Updates as ``(order, keys, set_<column>)``, a struct where the column is set, and
        inserted rows as ``(born, columns)``."""
        set_types = ", ".join(f"`set_{f.name}` struct<v: {f.dataType.simpleString()}>" for f in schema)
        key_types = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys or [])
        updates = [self.spark.createDataFrame([], ", ".join(x for x in ("order long", key_types, set_types) if x))]
        inserts = [self.spark.createDataFrame([], schema).select(F.lit(0).cast("long").alias("born"), "*")]
        for number, group in enumerate(self.groups):
            own = self.loads.where((F.col("group") == number) & (F.col("found") > 0) & (F.col("missing") == "")).select(
                "order", "operation", F.col("source_table").alias(SOURCE), "excess", "only_keys")
            have = {c.lower(): c for c in group.columns}
            if keys and all(k in have for k in keys):
                chosen = own.where("operation = 'UPDATE' AND excess = 0 AND NOT only_keys").where(~early).select("order", SOURCE)
                updates.append(chosen.join(group.rows, SOURCE).select(
                    "order", *(F.col(have[k]).cast(schema[k].dataType).alias(k) for k in keys),
                    *(F.struct(F.col(have[f.name]).cast(f.dataType).alias("v")).alias(f"set_{f.name}")
                      if f.name in have and f.name not in keys and number not in strange
                      else F.lit(None).cast(f"struct<v: {f.dataType.simpleString()}>").alias(f"set_{f.name}")
                      for f in schema)))
            if number not in strange:
                chosen = own.where("operation = 'INSERT'").select(F.col("order").alias("born"), SOURCE)
                inserts.append(chosen.join(group.rows, SOURCE).select("born", *(
                    (F.col(have[f.name]) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)))
        return stage(_union(updates), "updates"), _union(inserts)

    def _deletes(self, schema, early) -> tuple[list[tuple[list[str], DataFrame]], DataFrame]:
        """For each set of columns that conditions name: ``(order, cap, is_<column>)``; and what is
        wrong with the others."""
        parsed = F.from_json("filter_conditions", "map<string,string>")
        value = F.try_parse_json("filter_conditions")
        names = F.array(*map(F.lit, schema.names))
        all_names = F.coalesce(F.map_keys("conditions"), F.array().cast("array<string>"))
        ordered = F.concat(F.array_intersect("keys", all_names), F.array_except(all_names, "keys"))
        given = F.col("filter_conditions").isNotNull() & (F.trim("filter_conditions") != "null")
        rows = self.events.where("operation = 'DELETE'").where(~early).select(
            "order", "cap", "filter_conditions", parsed.alias("conditions"), "keys", value.alias("value")).withColumn(
            "named", ordered).withColumn("unknown", F.array_except("named", names))
        rows = rows.withColumn("error", (
            F.when(given & F.col("value").isNull(), "filter_conditions is not valid JSON")
            .when(given & ~F.schema_of_variant("value").startswith("OBJECT"), "filter_conditions must be a JSON object")
            .when(F.size("named") == 0, "at least one condition is required")
            .when(F.size("unknown") > 0, _said("unknown columns in conditions: ", F.array_join("unknown", ", ")))))
        rows = stage(rows.drop("value").withColumn("named", F.array_sort("named")), "deletes")
        out, wrong = [], [rows.where("error IS NOT NULL").select("order", "error")]
        for named in [r[0] for r in rows.where("error IS NULL").select("named").distinct().collect()]:
            own = rows.where(F.col("error").isNull() & (F.col("named") == F.array(*map(F.lit, named))))
            values = {c: F.col("conditions")[c] for c in named}
            typed = own.select("order", "cap", *(_comparable(v, schema[c].dataType).alias(f"is_{c}") for c, v in values.items()),
                               *(v.alias(f"text_{c}") for c, v in values.items()))
            problem = F.lit(None).cast("string")
            for c in named:
                problem = F.when(
                    F.col(f"text_{c}").isNotNull() & F.col(f"is_{c}").isNull(),
                    _said(f"condition on {c} is not of type {schema[c].dataType.simpleString()}: ", F.col(f"text_{c}"))
                ).otherwise(problem)
            typed = typed.withColumn("error", problem)
            wrong.append(typed.where("error IS NOT NULL").select("order", "error"))
            out.append((named, typed.where("error IS NULL").select("order", "cap", *(f"is_{c}" for c in named))))
        return out, _union(wrong)

    def _touched(self, schema, keys, updates, deletes) -> DataFrame:
        """The target's rows, marked if an update's key or a delete's conditions can meet them as
        they are. Conditions on what updates set meet later versions, which have a key's mark."""
        rows = self.target.read().withColumn("_touched", F.lit(False))
        marks = [(keys, updates.select(*keys).distinct(), lambda c: F.col(c))] if keys else []
        marks += [(named, d.select(*(F.col(f"is_{c}").alias(c) for c in named)).distinct(),
                   lambda c: _comparable(F.col(c), schema[c].dataType)) for named, d in deletes]
        for columns, values, at in marks:
            values = values.select(*(F.col(c).alias(f"_at_{c}") for c in columns), F.lit(True).alias("_mark"))
            same = None
            for c in columns:
                term = at(c) == F.col(f"_at_{c}")
                same = term if same is None else same & term
            rows = rows.join(values, same, "left").withColumn(
                "_touched", F.col("_touched") | F.coalesce("_mark", F.lit(False))).drop("_mark", *(f"_at_{c}" for c in columns))
        return rows.select(*schema.names, "_touched")

    def _versions(self, schema, keys, instances, updates) -> tuple[DataFrame, DataFrame]:
        """``(iid, born, order, until, columns)``, and the updates that meet an instance."""
        sets = [f"set_{f.name}" for f in schema]
        base = instances.select(
            "iid", "born", F.col("born").alias("order"), *(F.struct(F.col(n).alias("v")).alias(f"set_{n}") for n in schema.names))
        if not keys:
            met = base.where("false")
        else:
            met = stage(instances.select("iid", "born", *keys).join(updates, keys).where(
                F.col("order") > F.col("born")).select("iid", "born", "order", *sets), "updates-met")
        of = Window.partitionBy("iid").orderBy("order")
        upto = of.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        versions = base.unionByName(met).select(
            "iid", "born", "order", F.lead("order").over(of).alias("until"),
            *(F.last(s, ignorenulls=True).over(upto)["v"].alias(s[4:]) for s in sets))
        return stage(versions, "versions"), met.select("iid", "order")

    def _ends(self, schema, versions, deletes) -> tuple[DataFrame, DataFrame]:
        """``(iid, end)``: the delete that ends an instance; and the deletes that are refused."""
        if not deletes:
            return (self.spark.createDataFrame([], "iid long, end long"),
                    self.spark.createDataFrame([], "order long, error string"))
        every = _union([self.spark.createDataFrame([], "order long, cap long"), *(d.select("order", "cap") for _, d in deletes)])
        refused = self.spark.createDataFrame([], "order long")
        while True:
            found = [self.spark.createDataFrame([], "iid long, end long")]
            for named, rows in deletes:
                left = rows.join(refused, "order", "left_anti")
                values = [f"is_{c}" for c in named]
                # Once for each value, however many deletes name it.
                by_value = left.groupBy(*values).agg(F.array_sort(F.collect_list("order")).alias("orders"))
                hit = versions.join(by_value, self._same(schema, named)).select("iid", "until", F.when(
                    F.col("order") == 0, F.col("orders")[0]).otherwise(
                    F.get(F.filter("orders", lambda o: o > F.col("order")), F.lit(0))).alias("end"))
                found.append(hit.where("end IS NOT NULL AND (until IS NULL OR end < until)").select("iid", "end"))
            ends = stage(_union(found).groupBy("iid").agg(F.min("end").alias("end")), "ends")
            counts = ends.groupBy(F.col("end").alias("order")).agg(F.count(F.lit(1)).alias("n"))
            beyond = stage(every.join(counts, "order").where("cap IS NOT NULL AND n > cap").select("order"), "beyond")
            if beyond.isEmpty():
                break
            refused = stage(refused.unionByName(beyond), "refused")
        return ends, self._refusals(schema, versions, deletes, ends, refused)

    def _same(self, schema, named) -> Column:
        same = None
        for c in named:
            term = _comparable(F.col(c), schema[c].dataType) == F.col(f"is_{c}")
            same = term if same is None else same & term
        return same

    def _refusals(self, schema, versions, deletes, ends, refused) -> DataFrame:
        """What refused deletes say: the rows that they would have met."""
        lives = versions.withColumnRenamed("order", "since").join(ends, "iid", "left")
        found = [self.spark.createDataFrame([], "order long, error string")]
        for named, rows in deletes:
            over = rows.join(refused, "order", "left_semi")
            valid = (F.col("since") < F.col("order")) & (F.col("until").isNull() | (F.col("order") < F.col("until"))) & (
                F.col("end").isNull() | (F.col("order") < F.col("end")))
            counts = lives.join(over, self._same(schema, named)).where(valid).groupBy("order", "cap").agg(
                F.count(F.lit(1)).alias("n"))
            found.append(counts.select("order", _said("delete limit exceeded: ", F.col("n"), " > ", F.col("cap")).alias("error")))
        return stage(_union(found), "refusals")

    def _write(self, schema, touched, versions, met, ends) -> None:
        """One write: instances as they are at last, in place of the parts they were in."""
        names, part = schema.names, self.target.partition_by
        last = versions.where("until IS NULL").join(ends, "iid", "left_anti")
        fresh = last.where("born > 0").select(*names)
        changed = met.select("iid").unionByName(ends.select("iid")).distinct()
        first = versions.where("order = 0 AND born = 0").join(changed, "iid", "left_semi")
        if touched is None:
            self.target.overwrite(fresh, operation="fold")
        elif not part:
            if first.isEmpty():
                if not fresh.isEmpty():
                    self.target.append(fresh, operation="fold")
                return
            self.target.overwrite(
                touched.where("NOT _touched").select(*names).unionByName(last.select(*names)), operation="fold")
        else:
            parts = [row[0] for row in first.select(part).distinct().collect()]
            if not parts and fresh.isEmpty():
                return
            inside = F.col(part).isin([p for p in parts if p is not None]) | (
                F.col(part).isNull() if None in parts else F.lit(False))
            inside = F.coalesce(inside, F.lit(False))
            was = versions.where("order = 0 AND born = 0").where(inside).select("iid")
            kept = last.where("born = 0").join(was, "iid", "left_semi").select(*names)
            stay = touched.where(~F.col("_touched") & inside).select(*names)
            self.target.replace_parts(stay.unionByName(kept).unionByName(fresh), parts, operation="fold")


    def _change(self, schema, versions, met, ends) -> tuple[DataFrame, DataFrame]:
        """The rows that went and those that came."""
        hit = met.select("iid").unionByName(ends.select("iid")).distinct()
        was = versions.where("order = 0 AND born = 0").join(hit, "iid", "left_semi")
        last = versions.where("until IS NULL").join(ends, "iid", "left_anti")
        now = last.where("born > 0").unionByName(last.where("born = 0").join(hit, "iid", "left_semi"))
        return was.select(*schema.names), now.select(*schema.names)


def _failed(rows: DataFrame) -> DataFrame:
    """Outcomes of events with an ``error``."""
    none = F.lit(0).cast("long")
    return rows.select("order", none.alias("found"), none.alias("affected"), F.lit(None).cast("string").alias("warning"), "error")


def _results(queue: DataFrame, outcome: DataFrame, moment: datetime) -> DataFrame:
    """``RESULT_SCHEMA``, as one event after the other would have it."""
    done = queue.join(outcome, "order")
    expected = F.coalesce("expected", "found")
    counted = F.col("error").isNull() & ~F.coalesce(F.col("warning").startswith("no data to"), F.lit(False)) & F.col("allowed")
    status = F.when(~F.col("allowed"), "blocked").when(F.col("error").isNotNull(), "failed").otherwise("completed")
    columns = {
        "event_id": F.col("event_id"), "status": status,
        "rows_affected": F.when(counted, F.col("affected")).otherwise(0),
        "discrepancy": F.when(counted & (expected != F.col("affected")), expected - F.col("affected")),
        "warning": F.col("warning"),
        "error_message": F.when(F.col("allowed"), F.col("error")).otherwise("write access denied"),
        "processed_at": moment_literal(moment)}
    kinds = T.StructType.fromDDL(RESULT_SCHEMA)
    return done.select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in kinds))
