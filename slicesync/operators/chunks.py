"""Chunks of about equally many rows, however the key is distributed.

Marks cut the key's order into units of a quarter of a chunk. A value that
holds several units is cut further by a second column. Units in this order,
put together up to a chunk's size, become predicates that are disjoint and
whole. NULL keys are chunks of their own; of a cut value, rows without a second
value go to its first piece. A value that the second column cannot cut stays
one unit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicesync.functions.columns import lower_case_names
from slicesync.sources import jdbc
from slicesync.sources.jdbc import sql_literal

UNITS = 4  # of a chunk


@dataclass(frozen=True)
class Point:
    """All rows up to a key, or of that key only those up to a second value."""

    key: object
    second: object = None


@dataclass
class Statistics:
    """What the bounds are made from; all lists are as long as there are units, not rows."""

    rows: int
    null_rows: int
    marks: list                   # the key at every unit's end, in order, repeated if it holds several
    heavy: dict                   # exact rows of each repeated key
    second_marks: dict            # of each repeated key, and of None for NULL keys


def chunk_predicates(stats: Statistics, key: str, second: str, chunk_rows: int) -> list[str]:
    """One predicate a chunk, in the order of the key, NULL keys last."""
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be positive")
    predicates = []
    if stats.rows:
        target = stats.rows / -(-stats.rows // chunk_rows)
        ends, size = [], 0.0
        for point, weight in _units(stats):
            if ends and size + weight <= target:
                ends[-1], size = point, size + weight
            else:
                ends.append(point)
                size = weight
        for i, end in enumerate(ends):
            terms = [_above(ends[i - 1], key, second)] if i else []
            terms += [_up_to(end, key, second)] if i + 1 < len(ends) else []
            predicates.append(" AND ".join(terms) or f"{key} IS NOT NULL")
    if stats.null_rows:
        pieces = -(-stats.null_rows // chunk_rows)
        cuts = _thinned(stats.second_marks.get(None, []), pieces)
        for i in range(len(cuts) + 1):
            terms = [f"{key} IS NULL"]
            terms += [f"{second} > {sql_literal(cuts[i - 1])}"] if i else []
            if i < len(cuts):
                terms.append(f"({second} <= {sql_literal(cuts[i])} OR {second} IS NULL)")
            predicates.append(" AND ".join(terms))
    return predicates or ["1 = 1"]


def _units(stats: Statistics):
    """Points in order, each with the rows it has beyond the point before it."""
    unit = stats.rows / max(1, len(stats.marks))
    runs = [(value, len(list(same))) for value, same in groupby(stats.marks)]
    for value, repeated in runs:
        rows = stats.heavy.get(value)
        if repeated == 1 or rows is None:
            yield Point(value), repeated * unit
            continue
        cuts = _thinned(stats.second_marks.get(value, []), max(1, round(rows / unit)))
        around = max(0.0, repeated * unit - rows)  # smaller keys after the mark before
        for i, cut in enumerate(cuts):
            yield Point(value, cut), rows / (len(cuts) + 1) + (0 if i else around)
        yield Point(value), rows / (len(cuts) + 1) + (0 if cuts else around)


def _thinned(cuts: list, pieces: int) -> list:
    """At most ``pieces`` - 1 different cuts, evenly chosen."""
    chosen = [cuts[len(cuts) * i // pieces] for i in range(1, pieces)] if cuts else []
    return [value for value, _ in groupby(chosen)]


def _above(point: Point, key: str, second: str) -> str:
    value = sql_literal(point.key)
    if point.second is None:
        return f"{key} > {value}"
    return f"{key} >= {value} AND ({key} > {value} OR {second} > {sql_literal(point.second)})"


def _up_to(point: Point, key: str, second: str) -> str:
    value = sql_literal(point.key)
    if point.second is None:
        return f"{key} <= {value}"
    inner = f"{second} <= {sql_literal(point.second)} OR {second} IS NULL"
    return f"{key} <= {value} AND ({key} < {value} OR {inner})"


# --- statistics of a DataFrame ------------------------------------------------

def frame_statistics(df: DataFrame, key: str, second: str, chunk_rows: int) -> Statistics:
    """Three scans of the two columns at most; quantile summaries merge, no key is shuffled."""
    at, inner = F.col(f"`{key}`"), F.col(f"`{second}`")
    rows, null_rows = df.agg(F.count(at), F.count_if(at.isNull())).first()
    marks = df.agg(_cuts(at, rows, chunk_rows)).first()[0] if rows else []
    repeated = [value for value, same in groupby(marks) if len(list(same)) > 1]
    heavy, second_marks = {}, {}
    most = max(rows, null_rows)
    if repeated or null_rows > chunk_rows:
        shared = df.where(at.isin(repeated) | at.isNull() if repeated else at.isNull())
        found = shared.groupBy(at.alias("_key")).agg(
            F.count(F.lit(1)).alias("n"), _cuts(inner, most, chunk_rows).alias("cuts"))
        for value, n, cuts in found.collect():
            second_marks[value] = cuts or []
            if value is not None:
                heavy[value] = n
    return Statistics(rows, null_rows, marks, heavy, second_marks)


def _cuts(column: Column, rows: int, chunk_rows: int) -> Column:
    units = UNITS * -(-rows // chunk_rows)
    shares = F.array(*[F.lit(i / units) for i in range(1, units + 1)])
    return F.percentile_approx(column, shares, F.lit(max(10_000, 8 * units)))


def chunk_of(df: DataFrame, predicates: list[str]) -> DataFrame:
    """Rows with the number of the chunk they belong to."""
    numbers = [F.when(F.expr(predicate), F.lit(i)) for i, predicate in enumerate(predicates)]
    return df.withColumn("chunk", F.coalesce(*numbers))


# --- statistics of a database --------------------------------------------------

def database_statistics(
    run: Callable[[str], DataFrame], relation: str, key: str, second: str, chunk_rows: int
) -> Statistics:
    """The same from statements that the database answers with a row a unit."""
    counts = lower_case_names(run(
        f"SELECT COUNT({key}) AS n, COUNT(*) - COUNT({key}) AS missing FROM {relation}")).first()
    rows, null_rows = int(counts["n"]), int(counts["missing"])
    if not rows and not null_rows:
        return Statistics(0, 0, [], {}, {})
    units = UNITS * -(-rows // chunk_rows)
    marks = []
    if rows:
        tiles = (f"SELECT {key} AS mark, NTILE({units}) OVER (ORDER BY {key}) AS tile "
                 f"FROM {relation} WHERE {key} IS NOT NULL")
        found = run(f"SELECT tile, MAX(mark) AS mark FROM ({tiles}) t GROUP BY tile").collect()
        marks = [mark for _, mark in sorted(map(tuple, found))]
    repeated = [value for value, same in groupby(marks) if len(list(same)) > 1]
    wanted = [f"{key} IN ({', '.join(map(sql_literal, repeated))})"] if repeated else []
    wanted += [f"{key} IS NULL"] if null_rows > chunk_rows else []
    heavy, second_marks = {}, {}
    if wanted:
        pieces = UNITS * -(-max(rows, null_rows) // chunk_rows)
        tiles = (f"SELECT {key} AS k, {second} AS s, NTILE({pieces}) OVER (PARTITION BY {key} ORDER BY "
                 f"{second}) AS tile FROM {relation} WHERE {' OR '.join(wanted)}")
        found = run(f"SELECT k, tile, MAX(s) AS cut, COUNT(*) AS n FROM ({tiles}) t GROUP BY k, tile")
        for value, _, cut, n in sorted(map(tuple, found.collect()), key=lambda row: row[1]):
            if value is not None:
                heavy[value] = heavy.get(value, 0) + int(n)
            second_marks.setdefault(value, []).extend([] if cut is None else [cut])
    return Statistics(rows, null_rows, marks, heavy, second_marks)


def scan_balanced(
    spark: SparkSession, database: jdbc.Database, table: str, key: str, second: str,
    chunk_rows: int = jdbc.DEFAULT_FETCH_ROWS,
) -> DataFrame:
    """A table read in chunks of about ``chunk_rows`` rows, one task each, skewed keys or not."""
    stats = database_statistics(
        lambda text: jdbc.scan_query(spark, database, text), table, key, second, chunk_rows)
    return jdbc.scan_slices(spark, database, table, chunk_predicates(stats, key, second, chunk_rows))
