"""Tabular reports written as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def job_report(jobs: DataFrame, results: DataFrame, steps: DataFrame) -> DataFrame:
    """Job, step and query rows in one table, told apart by ``section``."""
    sections = {
        "job": jobs.select("job_id", F.col("job_id").cast("string").alias("name"), "status",
                           F.lit(None).cast("long").alias("rows_extracted"), "error"),
        "step": steps.select("job_id", F.col("step_name").alias("name"), "status",
                             F.lit(None).cast("long").alias("rows_extracted"), "error"),
        "query": results.select("job_id", F.col("query_name").alias("name"), "status",
                                F.col("rows_extracted").cast("long").alias("rows_extracted"),
                                "error"),
    }
    combined = None
    for section, rows in sections.items():
        part = rows.select(F.lit(section).alias("section"), "*")
        combined = part if combined is None else combined.unionByName(part)
    return combined


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("emptyValue", '""').csv(path)


def write_parts(
    df: DataFrame, path: str, rows_per_file: int, partition_by: tuple[str, ...] = ()
) -> None:
    """Parquet files of at most ``rows_per_file`` rows, by tenant and query."""
    writer = df.hint("rebalance", *partition_by).write if partition_by else df.write
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.option("maxRecordsPerFile", rows_per_file).parquet(path)
