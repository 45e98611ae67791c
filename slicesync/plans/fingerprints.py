"""Stored fingerprints of the last synchronised state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicesync.functions.periods import moment_literal, now_utc
from slicesync.operators.print_changes import moved_on, refuse_wrong
from slicesync.operators.slices import drop_slices, keep_slices
from slicesync.session import local_rows, stage
from slicesync.sources.versions import VersionedTable

COLUMNS = (
    "country string, table_name string, level string, level1_value string, "
    "level2_value string, row_count long, checksum_xor long, checksum_sum decimal(38,0), "
    "synced_at timestamp_ntz, job_id string, made_by string"
)
LEVELS = ("period", "product", "window", "watermark", "ranges")


# In place of a method: the target was written by a run that took no fingerprints.
UNKNOWN = "unknown"


class FingerprintStore:
    """Fingerprints below ``root``, one table per country, source table and level.

    A table holds one row per slice and is written anew when it changes: that
    is little next to the scan of the source that every sync needs. Rows say by
    which method and over which columns they were made; fingerprints made in
    another way cannot be compared, so they count as unknown.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, country: str, table_name: str, level: str) -> VersionedTable:
        if level not in LEVELS:
            raise ValueError(f"unknown level {level!r}; use one of {LEVELS}")
        return VersionedTable(self.spark, f"{self.root}/{country}/{table_name}/{level}")

    def find(self, country: str, table_name: str, level: str) -> DataFrame | None:
        """Stored fingerprints; None if none were ever saved."""
        try:
            return self.table(country, table_name, level).read()
        except LookupError:
            return None

    def known(self, country: str, table_name: str, level: str, made_by: str) -> bool:
        """False if what is stored was made in another way, or given up by ``forget``."""
        rows = self.find(country, table_name, level)
        return rows is not None and rows.where(F.col("made_by") != made_by).isEmpty()

    def forget(self, country: str, table_name: str, levels: tuple[str, ...] = LEVELS) -> None:
        """Give up the fingerprints of a target that is about to be written in another mode."""
        for level in levels:
            rows = self.find(country, table_name, level)
            if rows is not None and self.known(country, table_name, level, UNKNOWN) is False:
                mark = local_rows(self.spark, [(None, 0, 0)], "level1_value string, row_count long, "
                                  "checksum_xor long").withColumn("checksum_sum", F.lit(0))
                self.save(mark, country, table_name, level, made_by=UNKNOWN)

    def load(
        self, country: str, table_name: str, level: str, level1_values: list | None = None,
        made_by: str | None = None,
    ) -> DataFrame:
        """Stored fingerprints, without those made in another way than ``made_by``."""
        rows = self.find(country, table_name, level)
        if rows is None:
            return self.spark.createDataFrame([], COLUMNS)
        wanted = F.col("made_by") != UNKNOWN if made_by is None else F.col("made_by") == made_by
        rows = rows.where(wanted)
        if level1_values is None:
            return rows
        return keep_slices(rows, self._values(level1_values), ["level1_value"])

    def save(
        self,
        prints: DataFrame,
        country: str,
        table_name: str,
        level: str,
        job_id: str = "",
        level1_values: list | None = None,
        synced_at: datetime | None = None,
        made_by: str = "",
    ) -> int:
        """Replace the scope: the whole level, or the given level-1 values of it."""
        inner = F.col("level2_value") if "level2_value" in prints.columns else F.lit(None)
        rows = prints.select(
            F.lit(country).alias("country"),
            F.lit(table_name).alias("table_name"),
            F.lit(level).alias("level"),
            F.col("level1_value").cast("string").alias("level1_value"),
            inner.cast("string").alias("level2_value"),
            "row_count",
            "checksum_xor",
            F.col("checksum_sum").cast("decimal(38,0)").alias("checksum_sum"),
            moment_literal(synced_at or now_utc()).alias("synced_at"),
            F.lit(job_id).alias("job_id"),
            F.lit(made_by).alias("made_by"),
        )
        table = self.table(country, table_name, level)
        if level1_values is not None and table.exists():
            others = table.read().where(F.col("made_by") == made_by)
            others = drop_slices(others, self._values(level1_values), ["level1_value"])
            rows = others.unionByName(rows)
        # Sorted files let a load skip the level-1 values it does not want.
        return table.overwrite(
            rows.sortWithinPartitions("level1_value"), operation="save", job_id=job_id
        )

    def move_on(
        self, change: DataFrame, country: str, table_name: str, level: str, made_by: str, job_id: str = "",
    ) -> int | None:
        """Stored fingerprints after a change, as ``change_prints`` gives it, was applied: nothing
        but the change and what is stored of its level-1 values is read. None if nothing was
        known, which stays so."""
        if not self.known(country, table_name, level, made_by):
            return None
        keys = ["level1_value", "level2_value"] if "level2_value" in change.columns else ["level1_value"]
        change = stage(change.withColumns({k: F.col(k).cast("string") for k in keys}), "change")
        values = [row[0] for row in change.select("level1_value").distinct().collect()]
        before = self.load(country, table_name, level, values, made_by)
        after = stage(moved_on(before, change, keys), "moved-on")
        refuse_wrong(after, keys)
        return self.save(after, country, table_name, level, job_id, level1_values=values, made_by=made_by)

    def _values(self, values: list) -> DataFrame:
        texts = [(None if value is None else str(value),) for value in values]
        return local_rows(self.spark, texts, "level1_value string")
