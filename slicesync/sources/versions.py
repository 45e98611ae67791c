"""Tables kept as Parquet directories, one per commit, with a small history.

A commit first writes its rows to a directory of its own and then appends a few
rows to the history; only that append makes it visible. Nothing that a reader
may be reading is overwritten, a failed commit leaves the table as it was, and
only the partitions a commit touches are written again.

A table may deal the rows of a partition into buckets by a hash of another
column. Then a bucket of a partition is what a commit replaces, so a few changed
slices cost their buckets and not the whole partition.

One writer per table is assumed.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from slicesync.functions.columns import lower_case_names
from slicesync.functions.hashing import row_hash
from slicesync.functions.periods import moment_literal, now_utc

HISTORY_SCHEMA = (
    "version long, committed_at timestamp_ntz, operation string, action string, "
    "part string, bucket int, row_count long, job_id string, table_schema string"
)
_HISTORY = pa.schema(
    [("version", pa.int64()), ("committed_at", pa.timestamp("us")), ("operation", pa.string()),
     ("action", pa.string()), ("part", pa.string()), ("bucket", pa.int32()), ("row_count", pa.int64()),
     ("job_id", pa.string()), ("table_schema", pa.string())]
)
VERSION_COLUMN = "_version"
BUCKET_COLUMN = "_bucket"


#: Buckets of a partition, where a table has any.
DEFAULT_BUCKETS = 32


class VersionedTable:
    """A table at ``path``, optionally partitioned by one column and, within
    its partitions, dealt into ``buckets`` by a hash of ``bucket_by``.

    A unit of replacement is a partition value or, in a table with buckets, also
    a pair of it and a bucket. History actions: ``reset`` (all earlier rows are gone), ``replace`` (the
    part's earlier rows are gone), ``add`` and ``remove``.
    """

    def __init__(
        self, spark: SparkSession, path: str, partition_by: str | None = None,
        bucket_by: str | None = None, buckets: int = DEFAULT_BUCKETS,
    ):
        if bucket_by and not partition_by:
            raise ValueError("buckets are dealt within partitions")
        self.spark = spark
        self.path = path.rstrip("/")
        self.partition_by = partition_by
        self.bucket_by, self.buckets = bucket_by, buckets
        self._data = f"{self.path}/data"
        self._history = f"{self.path}/history"

    def bucket_of(self, column: str) -> Column:
        """The bucket of a value of ``bucket_by``, given as text or as it is; NULL is a value."""
        if not self.bucket_by:
            return F.lit(None).cast("int")
        return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(self.buckets)).cast("int")

    # --- history ----------------------------------------------------------

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(HISTORY_SCHEMA).parquet(self._history)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], HISTORY_SCHEMA)

    def _head(self, version: int | None = None) -> Row:
        """Latest version, its schema and the last reset, in one small aggregate."""
        log = self.log()
        if version is not None:
            log = log.where(F.col("version") <= version)
        return log.agg(
            F.max("version").alias("version"),
            F.max_by("table_schema", "version").alias("table_schema"),
            F.max(F.when(F.col("action") == "reset", F.col("version"))).alias("start"),
        ).first()

    def exists(self) -> bool:
        return self.latest_version() is not None

    def latest_version(self) -> int | None:
        return self._head()["version"]

    def version_at(self, moment: datetime) -> int:
        found = (
            self.log().where(F.col("committed_at") <= moment_literal(moment))
            .agg(F.max("version")).first()[0]
        )
        if found is None:
            raise LookupError(f"no version of {self.path} at {moment}")
        return found

    def history(self) -> DataFrame:
        """One row per version: when, which operation, rows written, parts touched."""
        return self.log().groupBy("version").agg(
            F.max("committed_at").alias("committed_at"),
            F.max("operation").alias("operation"),
            F.sum("row_count").alias("rows_written"),
            F.count_if(F.col("action") != "reset").alias("parts_touched"),
            F.max("job_id").alias("job_id"),
        )

    def rows_written(self, version: int) -> int:
        return self.log().where(F.col("version") == version).agg(F.sum("row_count")).first()[0]

    def live_parts(self, version: int | None = None) -> DataFrame:
        """(part, bucket, version) whose directories make up the given version."""
        return self._live(self._existing_head(version)).drop("whole")

    def _live(self, head: Row) -> DataFrame:
        """Live directories; ``whole`` says that all that their version wrote is live."""
        log = self.log().where(F.col("version").between(head["start"], head["version"]))
        replaced = F.when(F.col("action").isin("replace", "remove"), F.col("version"))
        base = F.max(replaced).over(Window.partitionBy("part", "bucket"))
        wrote = F.col("action").isin("replace", "add")
        live = wrote & (F.col("version") >= F.coalesce("_base", "version"))
        return (
            log.where("action <> 'reset'").withColumn("_base", base)
            .withColumn("whole", F.min(~wrote | live).over(Window.partitionBy("version")))
            .where(live).select("part", "bucket", "version", "whole")
        )

    def _existing_head(self, version: int | None = None) -> Row:
        head = self._head(version)
        if head["version"] is None:
            raise LookupError(f"no table at {self.path}")
        return head

    def schema(self, version: int | None = None) -> T.StructType:
        return _schema_of(self._existing_head(version))

    # --- reading ----------------------------------------------------------

    def read(self, version: int | None = None, parts: Iterable | None = None) -> DataFrame:
        """The table as of a version (default: now), optionally only some units."""
        head = self._existing_head(version)
        schema = _schema_of(head)
        if not self.partition_by and head["start"] == head["version"]:
            live = [(None, None, head["version"], True)]  # nothing was added since the last overwrite
        else:
            live = [tuple(row) for row in self._live(head).collect()]
        if parts is not None:
            wanted = _units(parts)
            live = [(p, b, v, False) for p, b, v, _ in live if (p, None) in wanted or (p, b) in wanted]
        if not live:
            return self.spark.createDataFrame([], schema)
        layout = [T.StructField(VERSION_COLUMN, T.LongType())]
        if self.bucket_by:
            layout.append(T.StructField(BUCKET_COLUMN, T.IntegerType()))
        files = (
            self.spark.read.schema(T.StructType([*schema.fields, *layout])).option("basePath", self._data)
            .parquet(*[f"{self._data}/{VERSION_COLUMN}={n}" for n in sorted({row[2] for row in live})])
        )
        if self.partition_by:
            # Only partition columns occur here, so this prunes directories; one look-up in a
            # set, however many commits and units there are.
            whole = sorted({v for _, _, v, all_live in live if all_live})
            some = [_directory(v, p, b) for p, b, v, all_live in live if not all_live]
            part = F.col(self.partition_by).cast("string")
            name = F.concat_ws(
                "/", VERSION_COLUMN, BUCKET_COLUMN if self.bucket_by else F.lit(""),
                F.when(part.isNull(), "").otherwise(F.concat(F.lit("="), part)))
            files = files.where(F.col(VERSION_COLUMN).isin(whole) | name.isin(some) if whole else name.isin(some))
        return files.select(*schema.names)

    def read_at(self, moment: datetime) -> DataFrame:
        return self.read(self.version_at(moment))

    # --- writing ----------------------------------------------------------

    def overwrite(self, df: DataFrame, **commit) -> int:
        """Replace the whole table, also by an empty one."""
        return self._commit(
            lower_case_names(df), None, commit.pop("operation", "overwrite"),
            self.latest_version(), **commit,
        )

    def append(self, df: DataFrame, **commit) -> int:
        """Add rows, columns by name; creates the table if there is none."""
        return self.replace_parts(df, [], **{"operation": "append", **commit})

    def replace_parts(
        self, df: DataFrame, parts: Iterable, operation: str = "replace", **commit
    ) -> int:
        """Put ``df`` in place of the given units; its rows elsewhere are added."""
        replaced = _units(parts)
        if replaced and not self.partition_by:
            raise ValueError("an unpartitioned table has no parts to replace")
        head = self._head()
        df = lower_case_names(df)
        if head["version"] is None:
            return self._commit(df, None, operation, None, **commit)
        df = align_columns(df, _schema_of(head))
        if self.bucket_by:  # a partition stands for the buckets that it has
            whole = {part for part, bucket in replaced if bucket is None}
            live = self._live(head).select("part", "bucket").distinct().collect() if whole else []
            replaced = {u for u in replaced if u[1] is not None} | {tuple(r) for r in live if r[0] in whole}
        return self._commit(df, replaced, operation, head["version"], **commit)

    def write_if_absent(self, df: DataFrame, **commit) -> int | None:
        """Write only where there is no table yet; returns None if skipped."""
        return None if self.exists() else self.overwrite(df, **commit)

    def _commit(
        self,
        df: DataFrame,
        replaced: set | None,
        operation: str,
        previous: int | None,
        job_id: str | None = None,
        committed_at: datetime | None = None,
    ) -> int:
        version = (previous or 0) + 1
        directory = f"{self._data}/{VERSION_COLUMN}={version}"
        # Rebalancing gathers each part's rows into few files, yet lets
        # adaptive execution split a part that is too large for one task.
        layout = [self.partition_by] if self.partition_by else []
        rows = df
        if layout:
            rows = df.withColumn(self.partition_by, _no_empty_text(df, self.partition_by))
            if self.bucket_by:
                rows = rows.withColumn(BUCKET_COLUMN, self.bucket_of(self.bucket_by))
                layout.append(BUCKET_COLUMN)
            writer = rows.hint("rebalance", *layout).write.partitionBy(*layout)
        else:
            writer = df.write
        # A directory left by a failed commit was never visible.
        writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(directory)

        written = self.spark.read.schema(rows.schema).parquet(directory)
        if self.partition_by:
            bucket = F.col(BUCKET_COLUMN) if self.bucket_by else F.lit(None)
            counts = {
                (row[0], row[1]): row[2]
                for row in written.groupBy(F.col(self.partition_by).cast("string"), bucket.cast("int"))
                .count().collect()
            }
        else:
            n = written.count()
            counts = {(None, None): n} if n else {}
        if replaced is None:
            actions = [((None, None), "reset", 0)] + [(unit, "add", n) for unit, n in counts.items()]
        else:
            actions = [
                (unit, "replace" if unit in replaced else "add", n) for unit, n in counts.items()
            ]
            actions += [(unit, "remove", 0) for unit in replaced if unit not in counts]
            actions = actions or [((None, None), "none", 0)]
        stamp = committed_at or now_utc()
        schema = df.schema.json()
        rows = [
            dict(zip(_HISTORY.names, (version, stamp, operation, action, *unit, n, job_id, schema)))
            for unit, action, n in actions
        ]
        # An Arrow table needs no Python worker; one file makes the commit atomic.
        entries = self.spark.createDataFrame(pa.Table.from_pylist(rows, schema=_HISTORY))
        entries.coalesce(1).write.mode("append").parquet(self._history)
        return version


def _units(parts: Iterable) -> set[tuple]:
    """Partition values, or pairs of one and a bucket, as pairs of text and bucket."""
    pairs = [part if isinstance(part, tuple) else (part, None) for part in parts]
    return {(None if part is None else str(part), bucket) for part, bucket in pairs}


def _directory(version: int, part: str | None, bucket: int | None) -> str:
    """A unit's name, as ``read`` makes it from the partition columns."""
    return f"{version}/{'' if bucket is None else bucket}/{'' if part is None else f'={part}'}"


def _no_empty_text(df: DataFrame, name: str):
    """The column itself; empty text is refused, as a directory name it reads as NULL."""
    column = F.col(name)
    if not isinstance(df.schema[name].dataType, T.StringType):
        return column
    refused = F.raise_error(F.lit(f"empty text in partition column {name}")).cast("string")
    return F.when(column == "", refused).otherwise(column)


def _schema_of(head: Row) -> T.StructType:
    return T.StructType.fromJson(json.loads(head["table_schema"]))


def align_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns by name in the table's order; a difference is an error.

    Replacing the table by the few rows at hand, as a way around a mismatch,
    would lose all other rows.
    """
    have, want = set(df.columns), set(schema.names)
    if have != want:
        raise ValueError(
            f"columns do not match the table: missing {sorted(want - have)}, "
            f"unknown {sorted(have - want)}"
        )
    columns = []
    for field in schema.fields:
        column = F.col(f"`{field.name}`")
        if df.schema[field.name].dataType != field.dataType:
            column = column.cast(field.dataType).alias(field.name)
        columns.append(column)
    return df.select(*columns)


def change_feed(
    table: VersionedTable, before: int, after: int, keys: Sequence[str]
) -> DataFrame:
    """Rows inserted, updated or deleted between two versions.

    Only parts whose directories differ are read. ``keys`` must be unique.
    """
    old, new = table.live_parts(before), table.live_parts(after)
    parts = None
    if table.partition_by:
        apart = old.exceptAll(new).unionAll(new.exceptAll(old)).select("part", "bucket").distinct()
        parts = [tuple(row) for row in apart.collect()]
    return changed_rows(table.read(before, parts), table.read(after, parts), keys)


def changed_rows(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows inserted, updated or deleted between two states with unique ``keys``.

    Only keys and row hashes are shuffled for the comparison, aggregated on the
    way; the changed rows alone are then fetched with all their columns. Rows
    whose 64-bit hashes agree count as equal.
    """
    names = after.columns
    both = before.select(*names, F.lit(False).alias("_now")).unionByName(
        after.select(*names, F.lit(True).alias("_now"))
    )
    hashed = both.select(*keys, "_now", row_hash(both, names).alias("_hash"))
    sides = hashed.groupBy(*keys).agg(
        F.max(F.when(~F.col("_now"), F.col("_hash"))).alias("_old"),
        F.max(F.when(F.col("_now"), F.col("_hash"))).alias("_new"),
    )
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete")
    changed = sides.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(
        *[F.col(key).alias(f"_k{i}") for i, key in enumerate(keys)],
        change.otherwise("update").alias("change_type"),
    )

    def fetched(rows: DataFrame, kinds: DataFrame) -> DataFrame:
        condition = None
        for i, key in enumerate(keys):
            term = rows[key].eqNullSafe(kinds[f"_k{i}"])
            condition = term if condition is None else condition & term
        return rows.join(kinds, condition).select("change_type", *[rows[name] for name in names])

    gone = F.col("change_type") == "delete"
    return fetched(after, changed.where(~gone)).unionByName(fetched(before, changed.where(gone)))
