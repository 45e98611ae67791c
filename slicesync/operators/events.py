"""The event queue as a relation: create, list, move between states, purge."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slicesync.functions.periods import since_days
from slicesync.operators.paging import page

# Operations and states of an event.
OPERATIONS = ("INSERT", "UPDATE", "DELETE")
STATUSES = ("pending", "processing", "completed", "failed", "blocked", "retry")
FINISHED = ("completed", "failed")
RETRYABLE = ("failed", "blocked")

EVENT_SCHEMA = (
    "event_id string, operation string, source_table string, target_table string, "
    "primary_keys array<string>, priority int, status string, rows_expected long, "
    "rows_affected long, discrepancy long, warning string, error_message string, "
    "retry_count int, max_retries int, filter_conditions string, metadata string, "
    "created_at timestamp_ntz, processed_at timestamp_ntz"
)
DEFAULT_PRIORITY = 5
DEFAULT_MAX_RETRIES = 3


def new_events(requests: DataFrame, created_at: Column) -> DataFrame:
    """Queue rows for the given requests, with defaults filled in.

    A request needs ``operation`` and ``target_table``. An id is made from the
    operation and a random UUID where none is given.
    """
    schema = StructType.fromDDL(EVENT_SCHEMA)
    defaults = {
        "event_id": F.concat_ws("-", F.lower("operation"), F.substring(F.uuid(), 1, 13)),
        "priority": F.lit(DEFAULT_PRIORITY),
        "primary_keys": F.array().cast("array<string>"),
        "source_table": F.lit(""),
        "retry_count": F.lit(0),
        "max_retries": F.lit(DEFAULT_MAX_RETRIES),
    }
    columns = []
    for field in schema.fields:
        value = F.col(field.name) if field.name in requests.columns else F.lit(None)
        if field.name == "status":
            value = F.lit("pending")
        elif field.name == "created_at":
            value = created_at
        elif field.name in ("filter_conditions", "metadata") and field.name in requests.columns:
            kind = requests.schema[field.name].dataType.typeName()
            value = F.to_json(field.name) if kind in ("map", "struct", "array") else value
        elif field.name in defaults:
            value = F.coalesce(value, defaults[field.name])
        columns.append(value.cast(field.dataType).alias(field.name))
    return requests.select(*columns)


def request_problem() -> Column:
    """Why a request may not be queued; NULL if it may."""
    no_keys = F.coalesce(F.size("primary_keys"), F.lit(0)) <= 0
    no_conditions = F.coalesce(F.trim("filter_conditions"), F.lit("")).isin("", "{}", "null")
    return (
        F.when(~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)),
               "unknown operation")
        .when(F.col("operation").isin("UPDATE", "DELETE") & no_keys, "primary keys are required")
        .when((F.col("operation") == "DELETE") & no_conditions, "conditions are required")
    )


def parsed_conditions(column: str = "filter_conditions") -> Column:
    """JSON object as a map; NULL where the text is not a JSON object."""
    return F.from_json(F.col(column), "map<string,string>", {"mode": "PERMISSIVE"})


def conditions_problem(column: str = "filter_conditions") -> Column:
    """Only the row whose text is broken fails, not the poll that reads it."""
    parsed = parsed_conditions(column)
    return F.when(
        F.col(column).isNotNull() & (parsed.isNull() | (F.size(F.map_keys(parsed)) == 0)),
        F.lit("filter_conditions is not a JSON object"),
    )


def queue_order() -> list[Column]:
    """Higher priority first, then older, then by id."""
    return [F.desc("priority"), F.asc("created_at"), F.asc("event_id")]


def pending(events: DataFrame, limit: int = 100) -> DataFrame:
    return page(events.where("status = 'pending'"), queue_order(), limit)


def filtered(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Equality on every filter that has a value; None does not restrict."""
    for name, value in filters.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def list_events(
    events: DataFrame, status: str | None = None, operation: str | None = None, limit: int = 100
) -> DataFrame:
    chosen = filtered(events, {"status": status, "operation": operation})
    return page(chosen, [F.desc("created_at"), F.asc("event_id")], limit)


def get_event(events: DataFrame, event_id) -> DataFrame:
    return events.where(F.col("event_id") == F.lit(event_id))


def record_results(events: DataFrame, results: DataFrame) -> DataFrame:
    """Put the outcome columns of ``results`` on the events they belong to."""
    outcome = ["status", "rows_affected", "discrepancy", "warning", "error_message",
               "processed_at"]
    renamed = results.select(
        F.col("event_id").alias("_event_id"), *[F.col(n).alias(f"_{n}") for n in outcome]
    )
    done = F.col("_event_id").isNotNull()
    return events.join(renamed, events["event_id"] == F.col("_event_id"), "left").select(
        *[
            F.when(done, F.col(f"_{name}")).otherwise(F.col(name)).alias(name)
            if name in outcome
            else events[name]
            for name in events.columns
        ]
    )


def retry(events: DataFrame, chosen: Column) -> DataFrame:
    """Chosen events go back to pending, if they failed or were blocked and have retries left."""
    left = F.lit(True)
    if "max_retries" in events.columns:  # NULL is no limit
        left = F.coalesce(F.col("retry_count") < F.col("max_retries"), F.lit(True))
    again = F.coalesce(chosen & F.col("status").isin(*RETRYABLE) & left, F.lit(False))
    return events.withColumns(
        {
            "status": F.when(again, "pending").otherwise(F.col("status")),
            "retry_count": F.col("retry_count") + again.cast("int"),
            "error_message": F.when(~again, F.col("error_message")),
            "warning": F.when(~again, F.col("warning")),
        }
    )


def cancel(events: DataFrame, chosen: Column) -> DataFrame:
    """Chosen events leave the queue, if they are still pending."""
    return events.where(~F.coalesce(chosen & (F.col("status") == "pending"), F.lit(False)))


def purge(events: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Without finished events created more than ``days`` ago."""
    old = F.col("status").isin(*FINISHED) & ~since_days("created_at", as_of, days)
    return events.where(~F.coalesce(old, F.lit(False)))


def fail_orphans(jobs: DataFrame, message: str) -> DataFrame:
    """Jobs still pending or running after a restart are marked failed."""
    orphan = F.col("status").isin("pending", "running")
    return jobs.withColumns(
        {
            "status": F.when(orphan, "failed").otherwise(F.col("status")),
            "error": F.when(orphan, F.lit(message)).otherwise(F.col("error")),
        }
    )


def event_counts(events: DataFrame) -> DataFrame:
    """Counts in total, by status and by operation, in one pass."""
    status, operation = F.col("status"), F.col("operation")
    grouped = events.groupingSets([[], [status], [operation]], status, operation)
    kind = (
        F.when((F.grouping("status") == 1) & (F.grouping("operation") == 1), "total")
        .when(F.grouping("operation") == 1, "status")
        .otherwise("operation")
    )
    counted = grouped.agg(kind.alias("scope"), F.count(F.lit(1)).alias("event_count"))
    value = (
        F.when(F.col("scope") == "total", "all")
        .when(F.col("scope") == "status", F.col("status"))
        .otherwise(F.col("operation"))
    )
    return counted.select("scope", value.alias("scope_value"), "event_count")
