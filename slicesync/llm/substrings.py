"""Removal of passages that repeat: Rabin-Karp hashes of every word window, counted.

Documents are dealt into blocks by a hash of their row. Each block hashes all windows of
its texts with two independent polynomials: one names the bucket, one is the value, so
both must agree by chance before two different windows are taken for one; for n windows
the expected number of such pairs is below ``n * BUCKET_WINDOWS / 2**64``. A block sends
each bucket its distinct values, packed, with a mark for values it holds more than once: a
passage in a third of all documents reaches its bucket once for each block. The bucket
counts and answers one bit for each value. The block's windows are hashed again, those
marked merge into maximal intervals, and the words they cover go.

Null text has no words. Texts shorter than a window lose nothing. Rows with the same id
are judged each for itself, and their passages count as repeated. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slicesync.llm.batches import words_of
from slicesync.llm.hashing import BASES, inner_windows, window_hashes, word_hashes

WINDOW = 35
BLOCK_BYTES = 8 << 20
BUCKET_WINDOWS = 1 << 21
#: A low estimate of the bytes of text for each window, to choose the number of buckets.
_BYTES_A_WINDOW = 6
_VALUES = pa.schema([
    ("bucket", pa.int32()), ("block", pa.int32()), ("values", pa.binary()), ("twice", pa.binary())])
_MARKS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("marks", pa.binary())])
_JUDGED = "n_words long, n_removed long, text string, removed array<struct<start: int, stop: int>>"


class _Windows:
    """All windows of a block's texts, grouped by bucket and value."""

    def __init__(self, texts: pa.Array, width: int, buckets: int):
        self.codes, self.offsets, self.words = words_of(texts)
        hashes = word_hashes(self.words)
        first, second = (hashes[self.codes, i] for i in (0, 1))
        inner = inner_windows(self.offsets, width)
        self.at = np.flatnonzero(inner)
        value = window_hashes(first, width, BASES[0])[self.at]
        bucket = (window_hashes(second, width, BASES[1])[self.at] % np.uint64(buckets)).astype(np.int32)
        self.order = np.lexsort((value, bucket))
        value, bucket = value[self.order], bucket[self.order]
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])
        starts = np.flatnonzero(fresh)
        self.group = np.cumsum(fresh) - 1
        self.value, self.bucket = value[starts], bucket[starts]
        self.twice = np.diff(np.append(starts, len(value))) > 1
        self.used, firsts = np.unique(self.bucket, return_index=True)
        self.cuts = np.append(firsts, len(self.bucket))


def _spans(covered: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of covered words: text, first word and end within the text."""
    n = len(covered)
    if not covered.any():
        return (np.zeros(0, np.int64),) * 3
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    begins = covered.copy()
    begins[1:] &= ~covered[:-1] | (text[1:] != text[:-1])
    ends = covered.copy()
    ends[:-1] &= ~covered[1:] | (text[1:] != text[:-1])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    own = text[first]
    assert n >= len(first)
    return own, first - offsets[own], last + 1 - offsets[own]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW,
) -> DataFrame:
    """``(row, n_words, n_removed, text, removed)``: the document's other columns, what is
    left of its text, and the intervals of words that went. Words are joined by one space."""
    others = [F.col(c) for c in docs.columns if c != text_col]
    chosen = docs.select(
        F.struct(*others).alias("row"), F.col(text_col).cast("string").alias("text"))
    total = int(chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks = total // BLOCK_BYTES + 1
    buckets = total // _BYTES_A_WINDOW // BUCKET_WINDOWS * 2 + 1
    dealt = chosen.withColumn("block", block_of(blocks, f"row.{id_col}", "text"))

    def values(table: pa.Table) -> pa.Table:
        found = _Windows(table.column("text").combine_chunks(), width, buckets)
        block, rows = table.column("block")[0].as_py(), []
        for bucket, low, high in zip(found.used.tolist(), found.cuts[:-1], found.cuts[1:]):
            rows.append({
                "bucket": bucket, "block": block, "values": found.value[low:high].tobytes(),
                "twice": np.packbits(found.twice[low:high]).tobytes()})
        return pa.Table.from_pylist(rows, schema=_VALUES)

    def marks(table: pa.Table) -> pa.Table:
        packed = table.column("values").to_pylist()
        sizes = [len(v) // 8 for v in packed]
        value = np.frombuffer(b"".join(packed), np.uint64)
        again = np.concatenate([
            np.unpackbits(np.frombuffer(t, np.uint8), count=n)
            for t, n in zip(table.column("twice").to_pylist(), sizes)]).astype(bool)
        order = np.argsort(value, kind="stable")
        same = value[order][1:] == value[order][:-1]
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        cuts = np.cumsum([0, *sizes])
        return pa.Table.from_arrays([
            table.column("block"), table.column("bucket"),
            pa.array([np.packbits(again[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
        ], schema=_MARKS)

    def judged(rows: pa.Table, answers: pa.Table) -> pa.Table:
        found = _Windows(rows.column("text").combine_chunks(), width, buckets)
        by_bucket = dict(zip(answers.column("bucket").to_pylist(), answers.column("marks").to_pylist()))
        repeated = np.concatenate([np.zeros(0, np.uint8), *(
            np.unpackbits(np.frombuffer(by_bucket[b], np.uint8), count=int(high - low))
            for b, low, high in zip(found.used.tolist(), found.cuts[:-1], found.cuts[1:]))])
        hits = found.at[found.order[repeated[found.group].astype(bool)]] if len(found.at) else found.at
        steps = np.zeros(int(found.offsets[-1]) + 1, np.int64)
        np.add.at(steps, hits, 1)
        np.add.at(steps, hits + width, -1)
        covered = np.cumsum(steps[:-1]) > 0
        own, first, stop = _spans(covered, found.offsets)
        n = len(rows)
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(own, np.arange(n + 1)).astype(np.int32)),
            pa.StructArray.from_arrays(
                [pa.array(first.astype(np.int32)), pa.array(stop.astype(np.int32))], ["start", "stop"]))
        kept_before = np.concatenate([[0], np.cumsum(~covered)])[found.offsets]
        kept = found.words.take(pa.array(found.codes[~covered]))
        lists = pa.ListArray.from_arrays(pa.array(kept_before.astype(np.int32)), kept)
        text = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
        counts = np.diff(found.offsets)
        return pa.Table.from_arrays([
            rows.column("row"), pa.array(counts), pa.array(counts - np.diff(kept_before)),
            text.cast(pa.string()), spans], ["row", "n_words", "n_removed", "text", "removed"])

    answers = (
        dealt.groupBy("block").applyInArrow(values, _ddl(_VALUES))
        .groupBy("bucket").applyInArrow(marks, _ddl(_MARKS)))
    out = StructType([chosen.schema["row"], *StructType.fromDDL(_JUDGED)])
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judged, out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """The documents with all their columns, and what is left of their text."""
    left = remove_repeats(docs, id_col, text_col, width)
    return left.select(*(
        F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def block_of(blocks: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)
