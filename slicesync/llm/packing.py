"""Best-fit packing of token sequences by hierarchical residual rounds.

Texts become pieces of at most ``capacity`` tokens; a longer text's first piece takes the
remainder and the others are full. In each round every task packs its items best-fit,
largest first, and emits the bins that are nearly full. Bins with room are items of the
next round, in fewer tasks: a tree of merges. Items are dealt by a hash, so that a source
with its own lengths doesn't fill a task alone. A task gets a bounded number of items
(``task_items``), however many remain; when only one task is left, or a round on several
tasks closes next to no bin, what remains is emitted as it is.

Null text is empty text (the end id alone, one piece). Rows with the same id are packed
each for itself. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicesync.llm.batches import slices
from slicesync.llm.bytebpe import ENCODED_BYTES, byte_bpe
from slicesync.session import stage

CAPACITY = 1024
#: A bin with at most this much room is emitted at once.
SLACK = 4
TASK_ITEMS = 100_000
FAN_IN = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMBER = f"struct<{', '.join(f'{n}: {t}' for n, t in (x.split() for x in PIECES.split(', ')))}>"
PLACED = f"{PIECES}, sequence_id long, offset long"
BINS = f"size int, bin long, members array<{_MEMBER}>"
_MEMBER_ARROW = pa.struct([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64())])
_BINS_ARROW = pa.schema([("size", pa.int32()), ("bin", pa.int64()), ("members", pa.list_(_MEMBER_ARROW))])


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece of each text: its place in the text and a checksum of its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer, end_id)
        for part in slices(batches, "text", ENCODED_BYTES):
            ids, offsets = encoder.encode(part.column("text"))
            rows: list[tuple] = []
            for number, low, high in zip(part.column("doc_id").to_pylist(), offsets[:-1], offsets[1:]):
                own, n = ids[low:high].astype("<u4", copy=False), int(high - low)
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                rows += [
                    (number, k, a, b - a, zlib.crc32(own[a:b]))
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*rows), _MEMBER_ARROW)],
                [t.name for t in _MEMBER_ARROW])

    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, largest first, goes where it leaves least room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[number].append(item)
        else:
            room, number = capacity, len(bins)
            bins.append([item])
        left = room - size
        if left:
            by_room[left].append(number)
            open_rooms |= 1 << left
    return bins


def _round(items: DataFrame, tasks: int, level: int, capacity: int) -> DataFrame:
    """One round: items regrouped into ``tasks`` tasks and packed in each of them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = TaskContext.get().partitionId() + (level << 20) << 32, 0
        held, rows = [], 0
        for batch in batches:
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= TASK_ITEMS:
                yield from _packed(held, known + count, capacity)
                held, rows, count = [], 0, count + rows
        if held:
            yield from _packed(held, known + count, capacity)

    # Dealt by a hash, so that each task has all sizes, whatever the order of the input;
    # which bins meet changes from round to round.
    return items.repartition(tasks, F.xxhash64("bin", F.lit(level))).mapInArrow(pack, BINS)


def _packed(held: list[pa.RecordBatch], first: int, capacity: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    table = table.sort_by([("size", "descending"), ("bin", "ascending")]).combine_chunks()
    sizes = table.column("size").to_numpy().astype(np.int64)
    bins = best_fit(sizes, capacity)
    members = table.column("members").combine_chunks()
    order = np.array([i for b in bins for i in b], np.int64)
    taken = members.take(pa.array(order))
    per_item = taken.offsets.to_numpy()
    cuts = np.concatenate([[0], np.cumsum([len(b) for b in bins])])
    filled = np.add.reduceat(sizes[order], cuts[:-1]) if len(order) else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([
        pa.array(filled.astype(np.int32)), pa.array(first + np.arange(len(bins), dtype=np.int64)),
        pa.ListArray.from_arrays(pa.array((per_item[cuts] - per_item[0]).astype(np.int32)), taken.flatten()),
    ], schema=_BINS_ARROW)


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces; no sequence exceeds ``capacity``."""
    spark = pieces.sparkSession
    pieces = stage(pieces.select(*(x.split()[0] for x in PIECES.split(", "))), "pieces")
    names = pieces.columns
    items = pieces.select(
        F.col("length").cast("int").alias("size"),
        F.xxhash64("doc_id", "piece", "ids_crc32").alias("bin"),
        F.array(F.struct(*names)).alias("members"))
    rounds: list[DataFrame] = []
    # Pieces that fill a sequence alone are done; the rest goes round.
    full = pieces.where(F.col("length") >= capacity - slack)
    left = items.where(F.col("size") < capacity - slack)
    level, tasks, before = 0, left.count() // TASK_ITEMS + 1, None
    while True:
        bins = stage(_round(left, tasks, level, capacity), f"bins-{level}")
        room = F.col("size") < capacity - slack
        count, open_bins = bins.agg(F.count("*"), F.count_if(room)).first()
        merges = -(-open_bins // TASK_ITEMS)
        stuck = before is not None and merges > 1 and count > 0.999 * before
        if tasks == 1 or open_bins <= 1 or stuck:
            rounds.append(bins)
            break
        rounds.append(bins.where(~room))
        left, level, tasks, before = bins.where(room), level + 1, max(merges, -(-tasks // FAN_IN)), open_bins
    packed = rounds[0]
    for more in rounds[1:]:
        packed = packed.unionAll(more)
    alone = full.select(
        *names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return packed.select("bin", "members").mapInArrow(_placed, PLACED).unionAll(alone)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of a bin with the tokens before it in the bin."""
    for batch in batches:
        members = batch.column("members")
        bounds, flat = members.offsets.to_numpy(), members.flatten()
        counts = np.diff(bounds)
        columns = [flat.field(t.name) for t in _MEMBER_ARROW]
        lengths = flat.field("length").to_numpy()
        before = np.cumsum(lengths) - lengths
        firsts = before[bounds[:-1] - bounds[0]] if len(before) else before
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.repeat(batch.column("bin").to_numpy(), counts)),
             pa.array(before - np.repeat(firsts, counts))],
            [*(t.name for t in _MEMBER_ARROW), "sequence_id", "offset"])
