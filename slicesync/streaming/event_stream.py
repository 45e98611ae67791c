"""The event queue as a stream: new event files in, result rows out.

An event that is delivered again within ``horizon`` of its arrival is dropped by the stream's
own keyed state, which expires with the horizon, so no result is read to find out what has
run. Time is that of the batch an event arrives in, so no event is ever too late. ``foreachBatch``
may see a batch again after a failure: a batch whose results are committed is skipped by its
number; one that was interrupted before runs again, as the queue promises at-least-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slicesync.operators.events import EVENT_SCHEMA, conditions_problem, request_problem
from slicesync.plans.fold import apply_all
from slicesync.plans.reverse import EventApplier
from slicesync.session import stage
from slicesync.sources.versions import VersionedTable

#: How long after its arrival an event's copies are known.
HORIZON = "7 days"
ARRIVED = "_arrived"


def read_events(spark: SparkSession, landing: str, files_per_batch: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
        .parquet(landing)
    )


def once(events: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Pending events, each once even if it is delivered again within the horizon."""
    arrived = events.where("status = 'pending'").withColumn(ARRIVED, F.current_timestamp())
    return arrived.withWatermark(ARRIVED, horizon).dropDuplicatesWithinWatermark(["event_id"]).drop(ARRIVED)


def stream_apply(
    events: DataFrame, results: VersionedTable, applier: EventApplier, checkpoint: str, horizon: str = HORIZON,
) -> StreamingQuery:
    """Apply each batch's events in queue order, all at once; a commit of results for each batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        label, waiting = f"{checkpoint}#{batch_id}", stage(batch, "batch")  # whole: its state is committed
        if results.log().where(F.col("job_id") == label).isEmpty():
            results.append(apply_all(waiting, applier), operation="results", job_id=label)

    return (
        once(events, horizon).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_status(
    events: DataFrame, results_path: str, checkpoint: str,
    outcome: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Check queued events in bulk and write one status row each.

    Each batch writes to a directory of its own, so a repeated batch replaces
    its rows instead of adding to them.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        checked = (outcome or check_events)(batch)
        checked.write.mode("overwrite").parquet(f"{results_path}/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def check_events(batch: DataFrame) -> DataFrame:
    """Status an event gets before any data is touched: processing or failed."""
    problem = F.coalesce(request_problem(), conditions_problem())
    return batch.select(
        "event_id",
        F.when(problem.isNull(), "processing").otherwise("failed").alias("status"),
        problem.alias("error_message"),
    )
