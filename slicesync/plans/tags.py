"""Version tags and the annotated history of a table."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicesync.functions.periods import now_utc
from slicesync.operators.events import filtered
from slicesync.operators.paging import page
from slicesync.sources.versions import VersionedTable

TAG_SCHEMA = (
    "table_name string, version long, tag string, description string, created_by string, "
    "created_at timestamp_ntz, job_id string"
)


def tag_text(tenant: str | Column, stage: str | Column, day: date | Column) -> Column:
    """``tenant-stage-YYYY-MM-DD``."""
    parts = [part if isinstance(part, Column) else F.lit(part) for part in (tenant, stage, day)]
    return F.concat_ws("-", parts[0], parts[1], F.date_format(parts[2], "yyyy-MM-dd"))


class TagRegistry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = VersionedTable(spark, path)

    def read(self) -> DataFrame:
        if not self.table.exists():
            return self.spark.createDataFrame([], TAG_SCHEMA)
        return self.table.read()

    def create(
        self,
        table_name: str,
        tagged: VersionedTable,
        tag: str,
        version: int | None = None,
        description: str | None = None,
        created_by: str = "system",
        created_at: datetime | None = None,
        job_id: str | None = None,
    ) -> int:
        """Tag a version (default: the latest); a tag is unique within its table."""
        if version is None:
            version = tagged.latest_version()
            if version is None:
                raise LookupError(f"{table_name} has no versions")
        if not self.get(table_name, tag).isEmpty():
            raise ValueError(f"tag {tag!r} already exists for {table_name}")
        row = (table_name, version, tag, description, created_by, created_at or now_utc(), job_id)
        self.table.append(self.spark.createDataFrame([row], TAG_SCHEMA), operation="tag")
        return version

    def get(self, table_name: str, tag: str) -> DataFrame:
        return filtered(self.read(), {"table_name": table_name, "tag": tag})

    def of(self, table_name: str) -> DataFrame:
        """All tags of a table; ``list`` shows a page of them."""
        return filtered(self.read(), {"table_name": table_name})

    def list(
        self, table_name: str | None = None, tag: str | None = None, limit: int = 50,
        offset: int = 0,
    ) -> DataFrame:
        chosen = filtered(self.read(), {"table_name": table_name, "tag": tag})
        return page(chosen, [F.desc("created_at"), "table_name", "tag"], limit, offset)

    def delete(self, table_name: str, tag: str) -> bool:
        if self.get(table_name, tag).isEmpty():
            return False
        gone = (F.col("table_name") == table_name) & (F.col("tag") == tag)
        self.table.overwrite(self.read().where(~gone), operation="untag")
        return True


def annotated_history(
    history: DataFrame, tags: DataFrame, keys: tuple[str, ...] = ("version",)
) -> DataFrame:
    """Each version with its tags, alphabetically; an untagged version has none."""
    named = tags.groupBy(*keys).agg(F.sort_array(F.collect_list("tag")).alias("_tags"))
    return history.join(named, list(keys), "left").select(
        *[history[name] for name in history.columns],
        F.coalesce(F.array_join("_tags", ","), F.lit("")).alias("tags"),
    )


def newest_versions(table: VersionedTable, limit: int = 20, offset: int = 0) -> DataFrame:
    return page(table.history(), [F.desc("version")], limit, offset)
