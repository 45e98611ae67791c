"""Scans: files, catalog tables, several servers, tenant overrides."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicesync.functions.columns import null_safe_equal

RESCUED_COLUMN = "_rescued_data"


def read_staged(spark: SparkSession, directory: str) -> DataFrame:
    """All Parquet files of a directory, without the reader's rescue column."""
    return spark.read.parquet(directory).drop(RESCUED_COLUMN)


def empty_relation(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """A relation with a schema and no rows, for a source that is missing."""
    return spark.createDataFrame([], schema)


def row_cap(df: DataFrame, rows: int | None, *order) -> DataFrame:
    """At most ``rows`` rows; give an order where the choice must be repeatable."""
    if rows is None:
        return df
    if rows <= 0:
        raise ValueError("row cap must be positive")
    return (df.orderBy(*order) if order else df).limit(rows)


def pre_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def column_metadata(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, nullable."""
    rows = [
        (position, field.name, field.dataType.simpleString(), field.nullable)
        for position, field in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, data_type string, is_nullable boolean"
    )


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    tables = spark.catalog.listTables(database)
    rows = [(table.name, table.tableType, table.isTemporary) for table in tables]
    return spark.createDataFrame(
        rows, "table_name string, table_type string, is_temporary boolean"
    )


def override_rows(common: DataFrame, tenant: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tenant rows win; a common row stays only where the tenant has no such key."""
    wanted = tenant.select(*keys).distinct()
    kept = common.join(wanted, null_safe_equal(common, wanted, keys), "left_anti")
    return tenant.unionByName(kept)


def entry_origin(common: DataFrame, tenant: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where each key comes from: ``common``, ``override`` or ``country-specific``."""
    sides = common.select(*keys, F.lit(1).alias("c"), F.lit(0).alias("t")).unionByName(
        tenant.select(*keys, F.lit(0).alias("c"), F.lit(1).alias("t"))
    )
    in_common, in_tenant = F.max("c") == 1, F.max("t") == 1
    origin = (
        F.when(in_common & in_tenant, "override")
        .when(in_tenant, "country-specific")
        .otherwise("common")
    )
    return sides.groupBy(*keys).agg(origin.alias("origin"))


def find_entry(common: DataFrame, tenant: DataFrame, keys: Mapping[str, object]) -> DataFrame:
    """The rows of one key, tenant first; no such key on either side is an error."""
    condition = None
    for name, value in keys.items():
        term = F.col(name).eqNullSafe(F.lit(value))
        condition = term if condition is None else condition & term
    for side in (tenant, common):
        found = side.where(condition)
        if not found.isEmpty():
            return found
    raise LookupError(f"no entry for {dict(keys)}")


class DatabaseMap:
    """Scans by three-part name; each database has a reader of its own."""

    def __init__(self, readers: Mapping[str, Callable[[str, str], DataFrame]]):
        self.readers = dict(readers)

    def scan(self, name: str) -> DataFrame:
        parts = name.split(".")
        if len(parts) != 3:
            raise ValueError(f"expected database.schema.table: {name!r}")
        database, schema, table = parts
        if database not in self.readers:
            raise LookupError(f"no reader for database {database!r}")
        return self.readers[database](schema, table)


def chunk_counts(df: DataFrame, key: str, chunk_rows: int) -> DataFrame:
    """How a scan in equal key ranges would split: rows and bounds per chunk.

    Uneven chunks show a skewed key before a long scan is started.
    """
    totals = df.agg(
        F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")
    ).first()
    if not totals["n"] or totals["lo"] is None:
        return empty_relation(
            df.sparkSession, "chunk long, row_count long, min_key long, max_key long"
        )
    chunks = -(-totals["n"] // chunk_rows)
    stride = -(-(totals["hi"] - totals["lo"] + 1) // chunks)
    chunk = F.expr(f"(`{key}` - {totals['lo']}) div {stride}")
    return df.groupBy(chunk.alias("chunk")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(key).alias("min_key"),
        F.max(key).alias("max_key"),
    )


def column_null_counts(df: DataFrame) -> DataFrame:
    """One row per column with its position and number of NULLs, in one scan."""
    counted = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in df.columns])
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(position).alias("position"),
                    F.lit(name).alias("column_name"),
                    F.col(name).alias("null_count"),
                )
                for position, name in enumerate(df.columns)
            ]
        )
    )
    return counted.select(pairs.alias("_c")).select("_c.*")


def union_servers(
    readers: Mapping[str, Callable[[], DataFrame]], label: str = "server"
) -> DataFrame:
    """The same table from several servers, each row labelled with its server."""
    if not readers:
        raise ValueError("no servers given")
    combined = None
    for server, read in readers.items():
        part = read().withColumn(label, F.lit(server))
        combined = (
            part if combined is None else combined.unionByName(part, allowMissingColumns=True)
        )
    return combined
