"""Apply queued events to target tables, one result row per event."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slicesync.functions.periods import now_utc
from slicesync.operators import apply as A
from slicesync.operators.events import queue_order
from slicesync.operators.slices import keep_slices
from slicesync.session import local_rows
from slicesync.sources.versions import VersionedTable

RESULT_SCHEMA = (
    "event_id string, status string, rows_affected long, discrepancy long, warning string, "
    "error_message string, processed_at timestamp_ntz"
)
DEFAULT_MAX_DELETE_ROWS = 10_000


class EventApplier:
    """Runs events in order. ``read_source`` and ``open_target`` resolve names."""

    def __init__(
        self,
        read_source: Callable[[str], DataFrame],
        open_target: Callable[[str], VersionedTable],
        max_delete_rows: int | None = DEFAULT_MAX_DELETE_ROWS,
        delete_cap_of: Callable[[Row], int | None] | None = None,
        allowed: Callable[[Row], bool] | None = None,
        clock: Callable[[], datetime] = now_utc,
    ):
        self.read_source = read_source
        self.open_target = open_target
        self.max_delete_rows = max_delete_rows
        self.delete_cap_of = delete_cap_of
        self.allowed = allowed
        self.clock = clock

    def apply(self, event: Row) -> dict:
        """Route by operation; whatever goes wrong becomes this event's result."""
        result = {
            "event_id": event["event_id"], "status": "completed", "rows_affected": 0,
            "discrepancy": None, "warning": None, "error_message": None,
        }
        try:
            if self.allowed and not self.allowed(event):
                result.update(status="blocked", error_message="write access denied")
            else:
                result.update(self._route(event))
        except Exception as error:  # one event must not stop the others
            result.update(status="failed", error_message=str(error).split("\n")[0])
        result["processed_at"] = self.clock()
        return result

    def _route(self, event: Row) -> dict:
        keys = list(event["primary_keys"] or [])
        A.check_keys(event["operation"], keys)
        actions = {"INSERT": self._insert, "UPDATE": self._update, "DELETE": self._delete}
        if event["operation"] not in actions:
            raise A.ApplyError(f"unknown operation: {event['operation']}")
        A.split_target(event["target_table"])
        return actions[event["operation"]](event, keys)

    def _source(self, event: Row) -> DataFrame:
        A.split_source(event["source_table"])
        return self.read_source(event["source_table"])

    def _insert(self, event: Row, keys: Sequence[str]) -> dict:
        source = self._source(event)
        target = self.open_target(event["target_table"])
        measured = source.agg(F.count(F.lit(1)).alias("n"))
        rows = measured.first()["n"]
        if rows == 0:
            return {"warning": "no data to insert"}
        warning = None
        if keys:
            A.check_columns(source, keys)
            excess = A.excess_key_rows(source, keys).first()[0]
            warning = f"found {excess} duplicate primary key rows" if excess else None
        if target.exists():
            empty = target.spark.createDataFrame([], target.schema())
            target.append(A.insert_rows(empty, source), operation="insert")
        else:
            target.overwrite(source, operation="insert")
        return self._counted(event, rows, rows, warning)

    def _update(self, event: Row, keys: Sequence[str]) -> dict:
        source = self._source(event)
        A.check_columns(source, keys)
        rows = source.count()
        if rows == 0:
            return {"warning": "no data to update"}
        if set(source.columns) == set(keys):
            return self._counted(event, rows, 0, "no columns to set")
        if A.excess_key_rows(source, keys).first()[0]:
            raise A.ApplyError("duplicate primary keys in the source of an update")
        target = self.open_target(event["target_table"])
        current = target.read()
        hits = keep_slices(current, source.select(*keys).na.drop("any"), keys)  # a NULL key meets nothing
        if not target.partition_by:
            affected = hits.count()
            if affected:
                target.overwrite(A.update_rows(current, source, keys), operation="update")
            return self._counted(event, rows, affected)
        per_part = hits.groupBy(target.partition_by).count().collect()
        if per_part:
            # Rows may move to another part, so all parts they touch are read.
            parts = {row[0] for row in per_part}
            changed = A.update_rows(target.read(parts=list(parts)), source, keys)
            target.replace_parts(changed, parts, operation="update")
        return self._counted(event, rows, sum(row[1] for row in per_part))

    def _delete(self, event: Row, keys: Sequence[str]) -> dict:
        conditions = event["filter_conditions"]
        if isinstance(conditions, str):
            try:
                conditions = json.loads(conditions)
            except ValueError:
                raise A.ApplyError("filter_conditions is not valid JSON") from None
        if not isinstance(conditions or {}, Mapping):
            raise A.ApplyError("filter_conditions must be a JSON object")
        target = self.open_target(event["target_table"])
        current = target.read()
        condition = A.match_condition(keys, conditions or {}, current.columns)
        part = target.partition_by
        hits = current.where(condition).groupBy(*([part] if part else []))
        per_part = [tuple(row) for row in hits.count().collect()]
        rows = sum(row[-1] for row in per_part)
        cap = self.max_delete_rows
        if self.delete_cap_of is not None:
            own = self.delete_cap_of(event)
            cap = own if own is not None else cap
        A.check_delete_cap(rows, cap)
        if rows and part:
            parts = [row[0] for row in per_part]
            kept = A.delete_rows(target.read(parts=parts), condition)
            target.replace_parts(kept, parts, operation="delete")
        elif rows:
            target.overwrite(A.delete_rows(current, condition), operation="delete")
        return self._counted(event, rows, rows)

    @staticmethod
    def _counted(event: Row, found: int, affected: int, warning: str | None = None) -> dict:
        # An expectation of 0 is an expectation; only NULL means none was given.
        expected = event["rows_expected"]
        expected = found if expected is None else expected
        return {
            "rows_affected": affected,
            "discrepancy": expected - affected if expected != affected else None,
            "warning": warning,
        }


def apply_events(events: DataFrame, applier: EventApplier) -> DataFrame:
    """Apply events in queue order; headers stream through the driver one by one."""
    results = [applier.apply(event) for event in events.orderBy(*queue_order()).toLocalIterator()]
    return result_rows(events.sparkSession, results)


def result_rows(spark: SparkSession, results: Sequence[dict]) -> DataFrame:
    names = StructType.fromDDL(RESULT_SCHEMA).names
    return local_rows(spark, [tuple(r[name] for name in names) for r in results], RESULT_SCHEMA)
