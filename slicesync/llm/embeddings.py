"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation that makes balanced binary codes is learnt on a bounded sample (``SAMPLE``
vectors, chosen by a hash): centre, principal axes, then alternately signs and the nearest
rotation. Codes are cut into chunks, and each chunk indexes a table: vectors of one label
that agree in a chunk meet in a bucket and are compared by their original vectors. A
chunk's width grows with the logarithm of the largest label, so buckets stay small; more
rotations are learnt until pairs just at the threshold meet with probability
``RECALL`` or more, as measured on the sample. Every vector is indexed.

Equal vectors of a label form one class first and cost one row from there on. A bucket of
more than ``BLOCK`` classes is dealt into blocks that meet two by two, so that no task
holds a large bucket and no pair of rows is ever emitted: a task returns counts, and one
link of each class to the smallest class it is connected with. A pair that meets in
several tables counts in the first.

Vectors that are null, zero, or hold a null or non-finite component, and those without
label or id, link with nothing; their component is their own id. Vectors of different
lengths link with nothing either. Rows with the same id are vectors of their own. No rows
give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicesync.llm.components import components
from slicesync.session import stage

THRESHOLD = 0.98
SAMPLE = 4096
RECALL = 0.998
BLOCK = 1024
#: Classes of a label that a bucket holds on average, which sets the chunks' width.
BUCKET = 16
_STEPS = 30


def learn_rotation(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (principal axes, rotated) whose signs quantise ``unit`` well."""
    mean = unit.mean(axis=0)
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    projected = centred @ axes
    random = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(random.standard_normal((unit.shape[1],) * 2))
    for _ in range(_STEPS):
        signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ signs)
        rotation = left @ right
    return mean, axes @ rotation


class Tables:
    """Chunks of binary codes: which bits of which rotation make each table's key."""

    def __init__(self, unit: np.ndarray, width: int, threshold: float, recall: float):
        n, size = unit.shape
        self.width = min(width, size)
        self.chunks: list[tuple[np.ndarray, np.ndarray]] = []
        random = np.random.default_rng(0)
        away = random.standard_normal(unit.shape)
        away -= (away * unit).sum(axis=1, keepdims=True) * unit
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        near = threshold * unit + math.sqrt(1 - threshold**2) * away
        missed, seed = np.ones(n, bool), 0
        while missed.mean() > 1 - recall and size > 1:
            mean, axes = learn_rotation(unit, seed)
            # Another order of the bits for each rotation, as their spread differs.
            order = random.permutation(size)
            for first in range(0, size - self.width + 1, self.width):
                self.chunks.append((mean, axes[:, order[first : first + self.width]]))
                one = len(self.chunks) - 1
                missed &= self._key(unit, one) != self._key(near, one)
                if missed.mean() <= 1 - recall:
                    break
            seed += 1
        if not self.chunks:  # vectors of one component: their sign is their direction
            self.chunks.append((np.zeros(size), np.ones((size, 1))))

    def _key(self, unit: np.ndarray, table: int) -> np.ndarray:
        mean, axes = self.chunks[table]
        bits = (unit - mean) @ axes >= 0
        return bits @ (1 << np.arange(axes.shape[1], dtype=np.int64))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Shape (vectors, tables)."""
        return np.stack([self._key(unit, t) for t in range(len(self.chunks))], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _classes(rows: DataFrame) -> DataFrame:
    good = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
        & (F.size("vector") > 0) & F.exists("vector", lambda x: x != 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    grouped = rows.where(good).groupBy("label", "vector").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n"))
    return stage(grouped.withColumn("cls", F.monotonically_increasing_id()).withColumn(
        "dim", F.size("vector")), "vectors")


def _compare(threshold: float):
    def links(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cls, n = table.column("cls").to_numpy(), table.column("n").to_numpy()
        unit = _unit(_matrix(table.column("vector").chunk(0)))
        keys = table.column("keys").chunk(0).flatten().to_numpy().reshape(len(cls), -1)
        own, at = table.column("own").to_numpy(), table.column("t")[0].as_py()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        counts, name = np.zeros(len(cls), np.int64), np.arange(len(cls))
        pairs = []
        for first in range(0, len(left), 256):
            some = left[first : first + 256]
            x, y = np.nonzero(unit[some] @ unit[right].T >= threshold)
            x, y = some[x], right[y]
            real = x < y if low == high else np.ones(len(x), bool)
            x, y = x[real], y[real]
            pairs.append((x, y))
            for begin in range(0, len(x), 1 << 18):
                a, b = x[begin : begin + (1 << 18)], y[begin : begin + (1 << 18)]
                fresh = ~(keys[a, :at] == keys[b, :at]).any(axis=1)
                np.add.at(counts, a[fresh], n[b[fresh]])
                np.add.at(counts, b[fresh], n[a[fresh]])
        x, y = (np.concatenate([p[i] for p in pairs] or [name[:0]]) for i in (0, 1))
        order = np.argsort(cls, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        name = rank.copy()
        while len(x):  # the smallest class of each local component
            least = np.minimum(name[x], name[y])
            after = name.copy()
            np.minimum.at(after, x, least)
            np.minimum.at(after, y, least)
            after = np.minimum(after, after[order[after]])
            if (after == name).all():
                break
            name = after
        linked = (counts > 0) | (name != rank)
        return pa.table({"cls": cls[linked], "links": counts[linked], "to": cls[order[name[linked]]]})

    return links


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, recall: float = RECALL,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``."""
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    classes = _classes(rows)
    bucketed = None
    for (dim,) in sorted(classes.select("dim").distinct().collect()):  # one index for each length
        own = classes.where(F.col("dim") == dim)
        largest = own.groupBy("label").count().agg(F.max("count")).first()[0]
        sample = own.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toArrow()
        unit = _unit(_matrix(sample.column("vector").combine_chunks()))
        width = max(2, math.ceil(math.log2(max(2, largest / BUCKET))))
        indexed = _indexed(own, Tables(unit, width, threshold, recall))
        bucketed = indexed if bucketed is None else bucketed.unionAll(indexed)
    if bucketed is None:
        return _labelled(rows, classes.select("label", "vector", F.col("least").alias("component_id"),
                                              F.lit(0).cast("long").alias("n_links")))
    found = stage(_dealt(stage(bucketed, "codes")).groupBy("t", "label", "dim", "key", "low", "high").applyInArrow(
        _compare(threshold), "cls long, links long, to long"), "links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    names = components(found.select(F.col("cls").alias("a"), F.col("to").alias("b")))
    named = classes.join(counts, "cls", "left").join(
        names.withColumnRenamed("node", "cls"), "cls", "left"
    ).withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return _labelled(rows, named.join(least, "component").select(
        "label", "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))


def _indexed(classes: DataFrame, tables: Tables) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = tables.keys(_unit(_matrix(batch.column("vector"))))
            ends = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
            yield batch.append_column("keys", pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1))))

    kinds = dict(classes.dtypes)
    names = ["cls", "label", "dim", "n", "vector"]
    return classes.select(*names).mapInArrow(
        code, ", ".join(f"{c} {kinds[c]}" for c in names) + ", keys array<bigint>")


def _dealt(coded: DataFrame) -> DataFrame:
    """A row for each table and pair of blocks in which a class is compared."""
    bucket = ["t", "label", "dim", "key"]
    spread = coded.select("*", F.posexplode("keys").alias("t", "key"))
    large = spread.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1").withColumn(
        "blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = spread.join(large, bucket).withColumn("own", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "blocks", "size")


def _labelled(rows: DataFrame, classes: DataFrame) -> DataFrame:
    out = rows.join(classes, ["label", "vector"], "left")
    mine = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    links = F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0))
    return out.select("vec_id", links.cast("long").alias("n_links"), mine.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
