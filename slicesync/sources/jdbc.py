"""Database scans and writes through Spark's JDBC source.

Aggregates such as a fingerprint are sent to the database as a query, because
reading every row over the wire to hash it here would defeat their purpose.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from slicesync.functions.periods import fill_placeholders

DEFAULT_FETCH_ROWS = 100_000


@dataclass(frozen=True)
class Database:
    """Where a database is and how to log on; ``options`` go to Spark unchanged."""

    url: str
    driver: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    def reader_options(self) -> dict[str, str]:
        chosen = {"url": self.url, "fetchsize": str(DEFAULT_FETCH_ROWS), **self.options}
        if self.driver:
            chosen["driver"] = self.driver
        return chosen


def query_options(database: Database, text: str, params: Mapping | None = None) -> dict[str, str]:
    return {**database.reader_options(), "query": fill_placeholders(text, dict(params or {}))}


def scan_query(
    spark: SparkSession, database: Database, text: str, params: Mapping | None = None
) -> DataFrame:
    """The result of one statement, read by one task: for small results."""
    return spark.read.format("jdbc").options(**query_options(database, text, params)).load()


def chunk_options(
    database: Database, table: str, key: str, lower: int, upper: int, chunk_rows: int, rows: int
) -> dict[str, str]:
    """Options of a scan in key ranges of about ``chunk_rows`` rows, one task each."""
    if upper < lower:
        raise ValueError("upper bound lies below the lower bound")
    if chunk_rows <= 0:
        raise ValueError("chunk_rows must be positive")
    return {
        **database.reader_options(),
        "dbtable": table,
        "partitionColumn": key,
        "lowerBound": str(lower),
        "upperBound": str(upper + 1),
        "numPartitions": str(max(1, -(-rows // chunk_rows))),
    }


def scan_chunked(
    spark: SparkSession,
    database: Database,
    table: str,
    key: str,
    chunk_rows: int = DEFAULT_FETCH_ROWS,
) -> DataFrame:
    """A parallel scan; the bounds and the row count come from one aggregate query."""
    bounds = scan_query(
        spark,
        database,
        f"SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT(*) AS n FROM {table}",
    ).first()
    reader = spark.read.format("jdbc")
    if not bounds["n"] or bounds["lo"] is None:
        return reader.options(**database.reader_options(), dbtable=table).load()
    options = chunk_options(
        database, table, key, int(bounds["lo"]), int(bounds["hi"]), chunk_rows, int(bounds["n"])
    )
    return reader.options(**options).load()


def spool(df: DataFrame, directory: str, rows_per_file: int = DEFAULT_FETCH_ROWS) -> DataFrame:
    """Write a scan to Parquet parts, each task its own, and read them back."""
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(directory)
    return df.sparkSession.read.schema(df.schema).parquet(directory)


def sql_literal(value: object) -> str:
    if isinstance(value, bool):
        raise TypeError("boolean keys are not supported")
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def slice_predicates(
    level1: str,
    level2: str,
    slices: Mapping[object, Sequence[object] | None],
    per_predicate: int = 200,
) -> list[str]:
    """Disjoint predicates for the slices to read, one task each.

    ``slices`` maps a level-1 value to its level-2 values, or to None for all.
    Keys stay bare, so the database can use an index.
    """
    predicates = []
    for outer, inner in slices.items():
        head = f"{level1} IS NULL" if outer is None else f"{level1} = {sql_literal(outer)}"
        if inner is None:
            predicates.append(head)
            continue
        known = [value for value in inner if value is not None]
        for start in range(0, len(known), per_predicate):
            values = ", ".join(sql_literal(v) for v in known[start : start + per_predicate])
            predicates.append(f"{head} AND {level2} IN ({values})")
        if len(known) < len(inner):
            predicates.append(f"{head} AND {level2} IS NULL")
    return predicates


def bucket_predicates(hashed: str, buckets: int) -> list[str]:
    """Disjoint predicates that split rows by a hash; rows without one go to the first."""
    first = f"{hashed} % {buckets} = 0 OR {hashed} IS NULL"
    return [first, *(f"{hashed} % {buckets} = {i}" for i in range(1, buckets))]


def scan_slices(
    spark: SparkSession, database: Database, table: str, predicates: Sequence[str]
) -> DataFrame:
    options = database.reader_options()
    return spark.read.jdbc(
        options.pop("url"), table, predicates=list(predicates), properties=options
    )


def fingerprint_query(
    source: str,
    groups: Sequence[tuple[str, str]],
    row_hash: str,
    xor: str,
    hash_sum: str,
    where: str = "",
) -> str:
    """Statement that lets the database fingerprint its own slices.

    ``groups`` pairs an expression with its output name; the hash of a row, the
    XOR aggregate and the sum of hashes are in the database's own spelling.
    """
    selected = [f"{expression} AS {name}" for expression, name in groups]
    selected += [
        "COUNT(*) AS row_count",
        f"{xor}({row_hash}) AS checksum_xor",
        f"{hash_sum} AS checksum_sum",
    ]
    text = f"SELECT {', '.join(selected)} FROM {source}"
    if where:
        text += f" WHERE {where}"
    if groups:
        text += f" GROUP BY {', '.join(expression for expression, _ in groups)}"
    return text


def write_table(
    df: DataFrame, database: Database, table: str, batch_rows: int = 10_000, tasks: int = 8
) -> None:
    """Append to a database table; ``tasks`` bounds the open connections.

    A retried task may insert its batch again, so the target needs a key, or
    the rows should go to a load table first.
    """
    options = database.reader_options()
    options.pop("fetchsize", None)
    # Dealt anew, so that the plan above keeps its own number of tasks.
    df.repartition(tasks).write.format("jdbc").options(
        **options, dbtable=table, batchsize=str(batch_rows)
    ).mode("append").save()
