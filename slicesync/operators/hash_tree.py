"""A tree of fingerprints below a slice, so that a large slice need not be read whole.

A row's place is a hash of its key. The tree cuts the places of a slice into
``FANOUT`` equal parts, and each of them again, down to a depth. A node holds
the fingerprint of its rows, so two states of a slice differ only below nodes
that differ, and the few leaves that remain name the rows to read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicesync.functions.hashing import row_hash
from slicesync.operators.fingerprint import classify, fingerprint
from slicesync.operators.intervals import cover, within
from slicesync.operators.slices import keep_slices
from slicesync.session import stage

BITS = 4
FANOUT = 1 << BITS
DEEPEST = 12  # node numbers stay positive longs
PLACE = "_place"


def depth_for(rows: int, leaf_rows: int) -> int:
    """Levels after which a slice of ``rows`` rows has about ``leaf_rows`` in a leaf."""
    if leaf_rows < 1:
        raise ValueError("leaf_rows must be positive")
    depth = 1
    while depth < DEEPEST and rows > leaf_rows * FANOUT**depth:
        depth += 1
    return depth


def place(
    df: DataFrame, key: Sequence[str], depth: int, method: str = "xxhash64", scale: int | None = None
) -> Column:
    """The leaf of a row; rows equal in the key share one."""
    if not 1 <= depth <= DEEPEST:
        raise ValueError(f"depth must be between 1 and {DEEPEST}")
    return F.shiftrightunsigned(row_hash(df, list(key), method, scale), 64 - BITS * depth)


def by_place(
    df: DataFrame, path: str, slices: Sequence[str], key: Sequence[str], depth: int,
    tasks: int | None = None, **hashing,
) -> DataFrame:
    """Rows written with their leaf, in files sorted by it, so that leaves prune the scan."""
    placed = df.withColumn(PLACE, place(df, key, depth, **hashing))
    order = [PLACE, *slices]
    dealt = placed.repartitionByRange(tasks, *order) if tasks else placed.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


class HashTree:
    """Fingerprints of all nodes, one folder a level, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, slices: Sequence[str], depth: int):
        self.spark, self.path, self.slices, self.depth = spark, path.rstrip("/"), list(slices), depth

    @classmethod
    def build(
        cls, df: DataFrame, path: str, slices: Sequence[str], key: Sequence[str], depth: int,
        columns: list[str] | None = None, placed: bool = False, **hashing,
    ) -> HashTree:
        """One scan for the leaves; each level above is added up from the one below. ``placed``:
        the rows hold the leaf that ``by_place`` gave them for the same key, depth and hash."""
        tree = cls(df.sparkSession, path, slices, depth)
        columns = columns or [name for name in df.columns if name != PLACE]
        leaf = F.col(PLACE) if placed else place(df, key, depth, **hashing)
        nodes = fingerprint(df.withColumn("node", leaf), [*slices, "node"], columns, **hashing)
        for level in range(depth, 0, -1):
            nodes.sortWithinPartitions("node").write.parquet(tree._level(level))
            nodes = tree.nodes(level).groupBy(
                *slices, F.shiftrightunsigned("node", BITS).alias("node")).agg(*_added_up())
        return tree

    def _level(self, level: int) -> str:
        return f"{self.path}/level={level}"

    def nodes(self, level: int, below: DataFrame | None = None) -> DataFrame:
        """All nodes of a level, or those below the given nodes of the level above."""
        found = self.spark.read.parquet(self._level(level))
        if below is None:
            return found
        ranges = [(low << BITS, (high << BITS) + FANOUT - 1) for low, high in cover(below, "node")]
        found = found.where(within(found, "node", ranges)).withColumn(
            "_parent", F.shiftrightunsigned("node", BITS))
        return keep_slices(
            found, below, [*self.slices, "_parent"], [*self.slices, "node"]).drop("_parent")


def _added_up() -> list[Column]:
    return [
        F.sum("row_count").alias("row_count"),
        F.bit_xor("checksum_xor").alias("checksum_xor"),
        F.sum("checksum_sum").cast("decimal(38,0)").alias("checksum_sum"),
    ]


def differing_leaves(now: HashTree, before: HashTree, slices: DataFrame | None = None) -> DataFrame:
    """Leaves that differ: slice, ``node``, status and both row counts.

    Goes down level by level and reads no node whose parent is equal. ``slices``
    limits the search to slices already known to differ.
    """
    if (now.slices, now.depth) != (before.slices, before.depth):
        raise ValueError("trees of different slices or depth cannot be compared")
    keys, changed = [*now.slices, "node"], None
    for level in range(1, now.depth + 1):
        sides = [tree.nodes(level, changed) for tree in (now, before)]
        if level == 1 and slices is not None:
            sides = [keep_slices(side, slices, now.slices) for side in sides]
        status = classify(*sides, keys).where("status <> 'unchanged'")
        changed = stage(status.select(*keys, "status", "row_count", "stored_row_count"), "nodes")
    return changed


def rows_of_leaves(placed: DataFrame, slices: Sequence[str], leaves: DataFrame) -> DataFrame:
    """Rows, as ``by_place`` wrote them, of some leaves."""
    inside = placed.where(within(placed, PLACE, cover(leaves, "node")))
    return keep_slices(inside, leaves, [*slices, PLACE], [*slices, "node"])


def differing_rows(now: DataFrame, before: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that one side has more often: ``change`` is their number now less that before."""
    sides = now.select(*columns, F.lit(1).alias("_n")).unionByName(
        before.select(*columns, F.lit(-1).alias("_n")))
    return sides.groupBy(*columns).agg(F.sum("_n").alias("change")).where("change <> 0")
