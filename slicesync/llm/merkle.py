"""Merkle manifest of a data set: a persistent tree whose versions share what they don't change.

Each row is a leaf: SHA-256 over its columns, each as byte count, ``:`` and value, or ``-`` if
null. Leaves of a key (language) ascend by id. Every ``FAN`` consecutive nodes make their parent
until one is left, the subroot; subroots ascend by key (null first) and make the root likewise.

The tree is built in aligned blocks of ``FAN ** DEPTH`` nodes: a block is one group of a shuffle,
and its top is a node of the next round's blocks, so there are few rounds, and no task holds more
than a block. A changed leaf makes a version of its block: its ancestors there are copied, one
node a level, and every other node is the block's own. A version goes on upwards by the copied
top of its block: the nodes beside a block's path to the root are the same for all versions that
come out of it, so they are found once for each block and joined to its versions, which are
spread as evenly as the leaves. That gives each version's root and each leaf's proof.

Rows with the same id ascend by their hash; equal rows have equal leaves, so their order does
not matter. Null ids come first and are never changed by the query. A key of one row has that
row as subroot, and a single subroot is the root. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicesync.session import stage

FAN = 2
#: Levels of a block.
DEPTH = 12
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 (binary) over the columns, each with its length before it."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _parent(nodes: Sequence[bytes]) -> bytes:
    """Hash of the digests as hex text."""
    return hashlib.sha256(b"".join(n.hex().encode() for n in nodes)).digest()


class PersistentTree:
    """The nodes of one aligned block. A node is its digest and the numbers of its children;
    nodes are only ever added, so each version keeps its root and all roots share nodes."""

    def __init__(self, leaves: Sequence[bytes], levels: int):
        self.digest: list[bytes] = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        row = list(range(len(leaves)))
        self.rows = [row]
        for _ in range(levels):
            row = [self._add(tuple(row[i : i + FAN])) for i in range(0, len(row), FAN)]
            self.rows.append(row)
        self.roots = {None: row[0]}

    def _add(self, children: tuple[int, ...]) -> int:
        self.digest.append(_parent([self.digest[c] for c in children]))
        self.children.append(children)
        return len(self.digest) - 1

    def change(self, version: object, place: int, leaf: bytes) -> list[bytes]:
        """A version with another leaf: that and its ancestors are copied, the rest is shared.
        The digests of the copies, from the leaf to the version's root."""
        self.digest.append(leaf)
        self.children.append(())
        node = first = len(self.digest) - 1
        for row, upper in zip(self.rows[:-1], self.rows[1:]):
            old = self.children[upper[place // FAN]]
            node = self._add(tuple(node if c == row[place] else c for c in old))
            place //= FAN
        self.roots[version] = node
        return self.digest[first:]

    def siblings(self, place: int) -> list[tuple[int, list[bytes]]]:
        """Level by level: the place among the run's nodes, and the others' digests."""
        out = []
        for row, upper in zip(self.rows[:-1], self.rows[1:]):
            run = self.children[upper[place // FAN]]
            out.append((place % FAN, [self.digest[c] for c in run if c != row[place]]))
            place //= FAN
        return out


def _packed(siblings: list[tuple[int, list[bytes]]]) -> bytes:
    """A level: the node's place in its run, the number of others, and their digests."""
    return b"".join(bytes([at, len(others)]) + b"".join(others) for at, others in siblings)


def _unpacked(path: bytes) -> list[tuple[int, list[bytes]]]:
    out, at = [], 0
    while at < len(path):
        place, count = path[at], path[at + 1]
        out.append((place, [path[at + 2 + 32 * k : at + 34 + 32 * k] for k in range(count)]))
        at += 2 + 32 * count
    return out


def ancestors(node: bytes, path: bytes) -> list[bytes]:
    """What a node and the digests beside its path give, level by level."""
    out = []
    for place, others in _unpacked(path):
        node = _parent([*others[:place], node, *others[place:]])
        out.append(node)
    return out


def proof_hash(path: bytes) -> str:
    """SHA-256 over the siblings of all levels as hex text."""
    return hashlib.sha256(b"".join(o.hex().encode() for _, others in _unpacked(path) for o in others)).hexdigest()


def ranked(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0 in ascending order within the key) and ``total``. Rows are
    range-sorted, and a task's rows of a key begin where the tasks before it end."""
    columns = rows.columns
    keys = [key, *order, "_tie"]
    sort = [F.col(c).asc_nulls_first() for c in keys]
    ordered = stage(
        rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*sort)
        .sortWithinPartitions(*sort).select(*columns, F.spark_partition_id().alias("_task"),
                                            F.monotonically_increasing_id().alias("_row")), "ranked")
    counts = ordered.groupBy(key, "_task").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    of_key = Window.partitionBy(key)
    before = F.coalesce(F.sum("n").over(
        of_key.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(
        F.col(key).alias("_key"), F.col("_task").alias("_of"), "_first", before.alias("_before"),
        F.sum("n").over(of_key).alias("total"))
    joined = ordered.join(starts, (F.col("_task") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.select(
        *columns, (F.col("_before") + F.col("_row") - F.col("_first")).alias("place"), "total")


def _levels(total: int) -> int:
    count = 0
    while total > 1:
        total, count = -(-total // FAN), count + 1
    return count


_BLOCK = (
    "key string, block long, place long, total long, number long, digest binary, path binary, copies binary")
_BLOCK_KINDS = (
    pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def _table(rows: list[tuple], kinds: Sequence[pa.DataType], schema: str) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.Table.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in schema.split(", ")])


def _block_tree(depth: int, done: int):
    """For one block: a row for each node with the digests beside its path and, if the node is
    changed, the copies of that version; and a row (place null) with the block's own top."""

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "number", "digest", "changed"))),
                      key=lambda r: r[0])
        key, block, total = (table.column(c)[0].as_py() for c in ("key", "block", "total"))
        tree = PersistentTree([r[2] for r in rows], min(depth, _levels(total) - done))
        out = []
        for at, (place, number, digest, changed) in enumerate(rows):
            copies = None if changed is None else b"".join(tree.change(place, at, changed))
            out.append((key, block, place, total, number, digest, _packed(tree.siblings(at)), copies))
        out.append((key, block, None, total, None, tree.digest[tree.roots[None]], None, None))
        return _table(out, _BLOCK_KINDS, _BLOCK)

    return build


class Forest:
    """The trees of all keys, for nodes ``(key, place, total, number, digest, changed)``.

    ``nodes``: ``(key, block, number, digest, path, copies)``, the digests beside a node's path
    within its block and the copies that the block's version with ``changed`` has (null without).
    ``blocks``: ``(key, block, above, root)``, the digests beside the block's path to the key's
    root, one row for each block."""

    def __init__(self, nodes: DataFrame, depth: int):
        width = FAN**depth
        largest = nodes.agg(F.max("total")).first()[0] or 0
        rounds, done = [], 0
        while True:
            blocks = nodes.withColumn("block", F.floor(F.col("place") / width))
            built = stage(
                blocks.groupBy("key", "block").applyInArrow(_block_tree(depth, done), _BLOCK), "merkle-blocks")
            rounds.append(built.where("place IS NOT NULL"))
            tops, done = built.where("place IS NULL"), done + depth
            if _levels(largest) <= done:
                break
            # A key that has its root already stays one block of one node.
            nodes = tops.select(
                "key", F.col("block").alias("place"), "total", F.lit(None).cast("long").alias("number"), "digest",
                F.lit(None).cast("binary").alias("changed"))
        above = tops.select("key", "block", F.lit(b"").alias("above"), F.col("digest").alias("root"))
        self.roots = above.select("key", "root")
        for rows in reversed(rounds[1:]):  # one row for each block of the round below
            above = rows.join(above, ["key", "block"]).select(
                "key", F.col("place").alias("block"), F.concat("path", "above").alias("above"), "root")
        self.nodes, self.blocks = rounds[0].drop("place", "total"), above


MANIFEST = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
    "verified boolean, copies array<string>")
_MANIFEST_KINDS = (pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.string()))


def manifest(
    docs: DataFrame, id_col: str = "doc_id", key_col: str = "lang", columns: Sequence[str] = LEAF_COLUMNS,
    changes: dict[str, Column] | None = None, where: Column | None = None, depth: int = DEPTH,
) -> DataFrame:
    """One row of ``MANIFEST`` for each row of ``docs``. Rows that ``where`` selects are changed by
    ``changes`` (column to expression), each in a version of its own: ``copies`` are that version's
    own nodes from the leaf up, the last of them is its root, ``folded_root``. For other rows
    ``folded_root`` is what leaf and proof give."""
    original = leaf_hash([F.col(c) for c in columns])
    other = leaf_hash([(changes or {}).get(c, F.col(c)) for c in columns])
    chosen = F.lit(False) if where is None else F.coalesce(where, F.lit(False))
    leaves = docs.select(
        F.col(id_col).cast("long").alias("number"),
        # Bytewise with null first: null is the empty key, and no other is empty.
        F.coalesce(F.concat(F.lit("="), F.col(key_col).cast("string")), F.lit("")).alias("key"),
        original.alias("digest"), F.when(chosen, other).alias("changed"))
    low = Forest(ranked(leaves, "key", ["number", "digest"]), depth)
    subroots = low.roots.select(F.lit("").alias("key"), F.col("key").alias("of"), F.col("root").alias("digest"))
    subroots = stage(ranked(subroots, "key", ["of"]), "merkle-subroots").withColumn("number", F.col("place"))
    high = Forest(subroots.withColumn("changed", F.lit(None).cast("binary")), depth)
    beyond = subroots.select("number", F.col("of").alias("key")).join(
        high.nodes.join(high.blocks, ["key", "block"]).select(
            "number", F.concat("path", "above").alias("beyond"), F.col("root").alias("whole")), "number")
    # Joined to a block's one row first, so that a leaf's join has its block as key.
    blocks = stage(
        low.blocks.join(beyond.drop("number"), "key").select(
            "key", "block", F.concat("above", "beyond").alias("above"), "root", "whole"), "merkle-above")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("number", "digest", "path", "above", "copies", "root", "whole")
        for batch in batches:
            out = []
            for number, leaf, path, above, copies, root, whole in zip(*(batch.column(c).to_pylist() for c in names)):
                path, own = path + above, None
                if copies is None:
                    last = [leaf, *ancestors(leaf, path)][-1]
                else:  # the version goes on above its block
                    own = [copies[i : i + 32] for i in range(0, len(copies), 32)]
                    own += ancestors(own[-1], above)
                    last = own[-1]
                out.append((
                    number, leaf.hex(), root.hex(), whole.hex(), proof_hash(path), last.hex(), last == whole,
                    own and [x.hex() for x in own]))
            yield from _table(out, _MANIFEST_KINDS, MANIFEST).to_batches()

    return low.nodes.join(blocks, ["key", "block"]).select(
        "number", "digest", "path", "above", "copies", "root", "whole").mapInArrow(fold, MANIFEST)
