"""Session defaults, driver rows, and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name: str = "slicesync", master: str | None = None, **conf) -> SparkSession:
    """A session with this package's defaults; keyword arguments override them.

    Keys are given with ``__`` for ``.``, e.g. ``spark__sql__shuffle__partitions=8``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Without the setting it is a folder below ``spark.sql.warehouse.dir``, which
    a cluster keeps on shared storage. A cluster whose warehouse is a folder of
    the driver's machine would lose data, so we refuse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named or context.getCheckpointDir():
        return (named or context.getCheckpointDir()).rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    on_one_machine = warehouse.startswith(("file:", "/")) or ":" not in warehouse
    if on_one_machine and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{warehouse}/_slicesync"


def run_dir(spark: SparkSession, label: str) -> str:
    """A path below the workspace that no other run uses."""
    return f"{workspace(spark)}/slicesync/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result feeds several later jobs. It cuts lineage, survives
    lost executors, and gives the planner the true size, so a join against it
    is broadcast only if it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few driver rows as a relation of known size, so that joins can broadcast it."""
    kinds = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    arrays = {
        field.name: pa.array(list(values), to_arrow_type(field.dataType))
        for field, values in zip(kinds, columns)
    }
    return spark.createDataFrame(pa.table(arrays), kinds)
