"""Where a differential sync gets its fingerprints and rows from."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicesync.functions.columns import lower_case_names
from slicesync.functions.hashing import made_by
from slicesync.operators.chunks import scan_balanced
from slicesync.operators.fingerprint import fingerprint, level1_fingerprint, level2_fingerprint
from slicesync.operators.slices import keep_slices, restrict
from slicesync.sources import jdbc

SLICE = ["level1_value", "level2_value"]
MEASURES = ["row_count", "checksum_xor", "checksum_sum"]

# Each value of these types has one text and each text one value, so a slice may be named by either.
# Others may not: 0.0 and -0.0 are equal and differ as text.
ONE_TEXT_A_VALUE = (
    T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DateType(), T.StringType(),
)

# Tasks that read one changed level-1 value, so that a large one is not read by one alone.
LEVEL2_BUCKETS = 8


def keyed(df: DataFrame, level1: str, level2: str) -> DataFrame:
    """Rows with their slice as text, the form fingerprints are stored in."""
    return df.withColumns(
        {
            "level1_value": F.col(level1).cast("string"),
            "level2_value": F.col(level2).cast("string"),
        }
    )


def by_value(
    df: DataFrame, slices: DataFrame, kinds: list[tuple[str, T.DataType | None]]
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows and slices for a join, and the rows' keys in it; ``kinds``: the slice columns and
    their types in the source, which are None if it does not say.

    Slices get values in place of texts where that is the same, so that the rows,
    which are many and wide, need not carry texts of columns that they hold.
    """
    keys = []
    for name, (column, kind) in zip(SLICE, kinds):
        if kind in ONE_TEXT_A_VALUE and df.schema[column].dataType == kind:
            slices = slices.withColumn(name, F.col(name).cast(kind))
            keys.append(column)
        else:
            df = df.withColumn(name, F.col(column).cast("string"))
            keys.append(name)
    return df, slices, keys


class FrameSource:
    """Slices of a DataFrame: files, a lake table, or any extraction of them."""

    reads_level1_whole = False

    def __init__(self, df: DataFrame, level1: str, level2: str):
        self.df = lower_case_names(df)
        self.level1, self.level2 = level1.lower(), level2.lower()
        self.made_by = made_by(self.df)

    @property
    def kinds(self) -> list[tuple[str, T.DataType | None]]:
        return [(name, self.df.schema[name].dataType) for name in (self.level1, self.level2)]

    def level1_prints(self) -> DataFrame:
        prints = level1_fingerprint(self.df, self.level1)
        return prints.withColumn("level1_value", F.col("level1_value").cast("string"))

    def level2_prints(self, values: list | None = None) -> DataFrame:
        """All slices, or those of some level-1 values, in one pass."""
        rows = self.df if values is None else restrict(self.df, self.level1, values)
        if all(kind in ONE_TEXT_A_VALUE for _, kind in self.kinds):
            prints = level2_fingerprint(rows, self.level1, self.level2, columns=self.df.columns)
            return prints.withColumns({name: F.col(name).cast("string") for name in SLICE})
        return fingerprint(
            keyed(rows, self.level1, self.level2), SLICE, self.df.columns
        )

    def all_rows(self) -> DataFrame:
        return self.df

    def slice_rows(self, slices: DataFrame, values: list) -> DataFrame:
        rows, slices, keys = by_value(restrict(self.df, self.level1, values), slices, self.kinds)
        return keep_slices(rows, slices, keys, SLICE).select(*self.df.columns)


class DatabaseSource:
    """Slices of a database table or subquery; the database fingerprints them itself.

    ``run`` executes one statement, ``read`` reads the rows of each predicate
    in a task of its own and ``read_all`` the whole relation. The spelling of
    the hash is the database's own. All rows of a changed level-1 value come
    over the wire, and count as downloaded. An engine that is ``parallel`` gives
    each statement many tasks itself, and is not asked once a bucket.
    """

    reads_level1_whole = True

    def __init__(
        self,
        relation: str,
        level1: str,
        level2: str,
        run: Callable[[str], DataFrame],
        read: Callable[[list[str]], DataFrame],
        read_all: Callable[[], DataFrame],
        row_hash: str = "CHECKSUM(*)",
        xor: str = "CHECKSUM_AGG",
        hash_sum: str = "SUM(CAST(CHECKSUM(*) AS BIGINT))",
        bucket_hash: str = "ABS(CAST(CHECKSUM({}) AS BIGINT))",
        buckets: int = LEVEL2_BUCKETS,
        parallel: bool = False,
    ):
        self.relation = relation
        self.level1, self.level2 = level1.lower(), level2.lower()
        self.run, self.read, self.read_all = run, read, read_all
        self.row_hash, self.xor, self.hash_sum = row_hash, xor, hash_sum
        self.bucket_hash, self.buckets, self.parallel = bucket_hash, buckets, parallel
        self.made_by = f"{row_hash} {xor} {hash_sum}"
        self.kinds = [(self.level1, None), (self.level2, None)]

    @classmethod
    def over_jdbc(
        cls, spark: SparkSession, database: jdbc.Database, table: str, level1: str, level2: str,
        chunk_key: str, **spelling,
    ) -> DatabaseSource:
        return cls(
            table, level1, level2,
            run=lambda text: jdbc.scan_query(spark, database, text),
            read=lambda predicates: jdbc.scan_slices(spark, database, table, predicates),
            read_all=lambda: scan_balanced(spark, database, table, chunk_key, level2),
            **spelling,
        )

    def _prints(self, groups: list[tuple[str, str]], where: str = "") -> DataFrame:
        text = jdbc.fingerprint_query(
            self.relation, groups, self.row_hash, self.xor, self.hash_sum, where
        )
        names = [name for _, name in groups]
        return lower_case_names(self.run(text)).select(
            *[F.col(name).cast("string").alias(name) for name in names],
            F.col("row_count").cast("long").alias("row_count"),
            F.col("checksum_xor").cast("long").alias("checksum_xor"),
            F.col("checksum_sum").cast("decimal(38,0)").alias("checksum_sum"),
        )

    def level1_prints(self) -> DataFrame:
        return self._prints([(self.level1, "level1_value")])

    def level2_prints(self, values: list | None = None) -> DataFrame:
        """One statement, and so one task unless the engine is parallel, a bucket of level-2 values;
        a slice is in one bucket."""
        groups = [(self.level1, "level1_value"), (self.level2, "level2_value")]
        scope = [] if values is None else [" OR ".join(self._level1_predicates(values))]
        parts = [
            self._prints(groups, _all_of([*scope, *bucket])) for bucket in self._buckets()
        ]
        return reduce(DataFrame.unionByName, parts)

    def _buckets(self) -> list[list[str]]:
        """Terms of each bucket; together the buckets hold every row, so one alone needs none."""
        if self.parallel:
            return [[]]
        return [[term] for term in jdbc.bucket_predicates(self.bucket_hash.format(self.level2), self.buckets)]

    def all_rows(self) -> DataFrame:
        return lower_case_names(self.read_all())

    def _level1_predicates(self, values: list) -> list[str]:
        return jdbc.slice_predicates(self.level1, self.level2, {value: None for value in values})

    def slice_rows(self, slices: DataFrame, values: list) -> DataFrame:
        """Rows of the changed level-1 values, a task for each value and bucket of level 2;
        the slices among them are picked by a semi join, however many they are."""
        predicates = [
            _all_of([value, *bucket])
            for value in self._level1_predicates(values)
            for bucket in self._buckets()
        ]
        rows = lower_case_names(self.read(predicates))
        return keep_slices(keyed(rows, self.level1, self.level2), slices, SLICE).drop(*SLICE)


def _all_of(terms: list[str]) -> str:
    return " AND ".join(f"({term})" for term in terms)
