"""Roll-ups over jobs, their query results and pipeline steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_TYPE = (
    "array<struct<query_name:string,status:string,rows_extracted:bigint,error:string>>"
)


def latest_per(
    jobs: DataFrame, tenant: str, moment: str, columns: list[str], tie_break: str
) -> DataFrame:
    """The latest row of each tenant; equal moments are decided by ``tie_break``.

    Each task keeps one row per tenant before the shuffle, so a tenant with most
    of the rows is no burden, as it would be for a window.
    """
    best = F.max_by(F.struct(*columns), F.struct(moment, tie_break)).alias("_best")
    return (
        jobs.where(F.col(moment).isNotNull()).groupBy(tenant).agg(best)
        .select(tenant, *[F.col(f"_best.{name}").alias(name) for name in columns])
    )


def overall_status(completed: Column, failed: Column) -> Column:
    """Failed only if something failed and nothing completed."""
    return F.when((failed > 0) & (completed == 0), "failed").otherwise("completed")


def job_rollup(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per job: queries completed and failed, rows extracted, overall status."""
    completed = F.count_if(F.col("status") == "completed")
    failed = F.count_if(F.col("status") == "failed")
    counted = results.groupBy(*keys).agg(
        completed.alias("queries_completed"),
        failed.alias("queries_failed"),
        F.coalesce(F.sum("rows_extracted"), F.lit(0)).alias("total_rows"),
    )
    return counted.withColumn(
        "status", overall_status(F.col("queries_completed"), F.col("queries_failed"))
    )


def explode_results(jobs: DataFrame, column: str = "results") -> DataFrame:
    """One row per query result out of the JSON array kept with a job."""
    parsed = F.from_json(F.col(column), RESULT_TYPE)
    return jobs.withColumn("_r", F.explode(parsed)).select(
        *[name for name in jobs.columns if name != column], "_r.*"
    )


def progress(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Completed share of the steps in percent, one decimal."""
    done = F.count_if(F.col("status") == "completed")
    total = F.count(F.lit(1))
    return steps.groupBy(*keys).agg(
        total.alias("steps_total"),
        done.alias("steps_completed"),
        F.round(done * 100.0 / total, 1).cast("double").alias("progress_pct"),
    )


def step_progress(status: Column, substeps: Column, completed: Column) -> Column:
    """Progress of one step: by its substeps, else 100, 50 or 0 by its status."""
    by_status = F.when(status == "completed", 100.0).when(status == "running", 50.0).otherwise(0.0)
    return F.when(substeps > 0, F.round(completed * 100.0 / substeps, 1).cast("double")).otherwise(
        by_status
    )
