"""Removal of byte strings that repeat, by suffix arrays built from Lyndon-prefix groups.

Texts are UTF-8 bytes, dealt into blocks by a hash of their row; a string of ``width`` bytes
that starts anywhere else too goes, same text included. Matches never cross texts. A block is
read three times, and its rows come in any order, so each time it puts its texts in order.

1. A window's anchor is the smallest hash of its ``gram``-byte strings, so equal windows have
   equal anchors. Consecutive windows of one anchor are a run. A block sends each bucket its
   distinct anchors and the hashes of its distinct whole runs, packed. A run that occurs twice
   is a copy: all of it repeats, and from here on only the first block that has it looks at
   it, once. An anchor that
   occurs in different runs, or several times in one, leaves open which of their windows are
   equal; any other anchor leaves nothing to compare.
2. Each block writes the windows of its open runs, every different run once, into parts of
   bounded size and builds a suffix array of each part (``lyndon.suffix_array``). Neighbours
   in it that agree in ``width`` bytes are one class; one hash for each class goes to its
   bucket, which counts and answers one bit.
3. Windows that repeat merge into maximal spans, and the bytes they cover go.

Hot runs and anchors reach a bucket once for each block, however often they occur. Runs and
classes are told apart by two independent polynomials over all their bytes, one of which
names the bucket; within a part bytes are compared.

Null text is empty text; texts shorter than ``width`` lose nothing. Rows with the same id or
equal rows are texts of their own, so equal texts of ``width`` bytes or more go entirely. No
rows give no rows. Other columns are carried along in ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slicesync.llm.hashing import BASES, mixed
from slicesync.llm.lyndon import suffix_array

WIDTH = 200
BLOCK_BYTES = 4 << 20
#: Windows that are hashed at once, and bytes of one suffix array; both stay in a core's cache.
SLICE = 1 << 17
PART = 1 << 16
BUCKET_VALUES = 1 << 21
_SENT = pa.schema([
    ("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("values", pa.binary()),
    ("extra", pa.binary())])
_MARKS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("marks", pa.binary())])
_SENT_DDL = "bucket int, block int, kind int, values binary, extra binary"
_MARKS_DDL = "block int, bucket int, kind int, marks binary"
_JUDGED = (
    "n_bytes long, n_removed long, n_spans long, kept binary, "
    "removed array<struct<start: int, stop: int>>")
ANCHORS, RUNS, WINDOWS, LEADS = 0, 1, 2, 3
_BYTES = mixed(np.arange(1, 513, dtype=np.uint64) << np.uint64(20)).reshape(2, 256)


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """Polynomial hashes of any stretch of a slice, from prefix sums; ``which`` is 0 or 1."""

    def __init__(self, longest: int):
        self.rising = [_powers(np.uint64(pow(int(b), -1, 1 << 64)), longest + 1) for b in BASES]
        self.falling = [_powers(b, longest + 1) for b in BASES]

    def sums(self, raw: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[which][raw] * self.rising[which][: len(raw)], out=out[1:])
        return out

    def stretches(self, sums: np.ndarray, first: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        length = (stop - first).astype(np.uint64)
        return mixed((sums[stop] - sums[first]) * self.falling[which][first] + length)

    def grams(self, sums: np.ndarray, width: int) -> np.ndarray:
        n = len(sums) - width
        return mixed((sums[width:] - sums[:n]) * self.falling[0][:n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values, from those of half as many."""
    have = 1
    while 2 * have <= width:
        values, have = np.minimum(values[:-have], values[have:]), 2 * have
    more = width - have
    return np.minimum(values[: len(values) - more], values[more:]) if more else values


def _several(grams: np.ndarray, least: np.ndarray, first: np.ndarray, stop: np.ndarray, within: int) -> np.ndarray:
    """Whether a run has its anchor more than once, so that its own windows may be equal."""
    edge = np.zeros(within - 1, np.uint64)
    most = ~_least(~np.concatenate([edge, least, edge]), within)
    at = np.flatnonzero(grams == most)  # smallest of some window
    values, number = np.unique(grams[at], return_inverse=True)
    n = len(grams) + 1
    places = np.sort(number * n + at)
    own = np.searchsorted(values, least[first]) * n
    second = np.searchsorted(places, own + first) + 1
    return np.append(places, np.iinfo(np.int64).max)[np.minimum(second, len(places))] <= own + stop + within - 2


class _Runs:
    """All runs of a block's texts: first window, stop, anchor, two hashes of the run, and, if
    asked for, whether the anchor is in it several times."""

    def __init__(
        self, texts: pa.Array | pa.ChunkedArray, width: int, gram: int, buckets: int, several: bool = False,
    ):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        # Where slices cut the runs depends on the order of the texts.
        self.order = pc.sort_indices(texts)
        texts = texts.take(self.order)
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
        self.offsets, self.width = ends - ends[0], width
        n = len(self.raw)
        self.inside = np.ones(n, bool)
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            self.inside[max(a, b - width + 1) : b] = False
        self.hasher = _Hasher(min(n, SLICE) + width)
        found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, bool),)]
        for at, part in self._slices():
            sums, other = (self.hasher.sums(part, i) for i in (0, 1))
            grams, within = self.hasher.grams(sums, gram), width - gram + 1
            least = _least(grams, within)
            ok = self.inside[at : at + len(least)]
            begin, more = ok.copy(), ok.copy()
            same = least[1:] == least[:-1]
            begin[1:] &= ~(ok[:-1] & same)
            more[:-1] &= ~(ok[1:] & same)
            first, stop = np.flatnonzero(begin), np.flatnonzero(more) + 1
            end = stop + width - 1
            found.append((
                first + at, stop + at, least[first], self.hasher.stretches(sums, first, end, 0),
                self.hasher.stretches(other, first, end, 1),
                _several(grams, least, first, stop, within) if several else np.zeros(len(first), bool)))
        self.first, self.stop, self.anchor, self.value, second, self.several = map(np.concatenate, zip(*found))
        self.bucket = (second % np.uint64(buckets)).astype(np.int32)
        self.anchor_bucket = (mixed(self.anchor) % np.uint64(buckets)).astype(np.int32)
        self.runs, self.anchors = _Distinct(self.bucket, self.value), _Distinct(self.anchor_bucket, self.anchor)

    def _slices(self) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(self.raw), SLICE):
            part = self.raw[at : at + SLICE + self.width - 1]
            if len(part) >= self.width:
                yield at, part

    def opened(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The runs whose windows this block compares, each different one once, and which runs are
        copies. An open run that is no copy is compared by its own block."""
        led = self.runs.first[self.runs.answered(answers, LEADS)]
        led = led[self.anchors.answered(answers, ANCHORS)[self.anchors.number[led]]]
        return np.sort(led), self.runs.answered(answers, RUNS)[self.runs.number]

    def windows(self, chosen: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, buckets and values of the windows of the chosen runs."""
        steps = np.zeros(len(self.raw) + 1, np.int8)
        steps[self.first[chosen]] += 1
        steps[self.stop[chosen]] -= 1
        wanted = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64))]
        for at, part in self._slices():
            own = np.flatnonzero(wanted[at : at + min(SLICE, len(part) - self.width + 1)])
            if len(own):
                value, second = (
                    self.hasher.stretches(self.hasher.sums(part, i), own, own + self.width, i) for i in (0, 1))
                found.append((own + at, (second % np.uint64(buckets)).astype(np.int32), value))
        return tuple(map(np.concatenate, zip(*found)))


class _Distinct:
    """Distinct (bucket, value) pairs in order, and which of them each item is."""

    def __init__(self, bucket: np.ndarray, value: np.ndarray):
        order = np.lexsort((value, bucket))
        b, v = bucket[order], value[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (b[1:] != b[:-1])
        starts = np.flatnonzero(new)
        self.number = np.empty(len(v), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.first = order[starts]
        self.bucket, self.value = b[starts], v[starts]
        self.twice = np.diff(np.append(starts, len(v))) > 1
        self.used, cuts = np.unique(self.bucket, return_index=True)
        self.cuts = np.append(cuts, len(self.bucket))

    def __len__(self) -> int:
        return len(self.value)

    def rows(self, block: int, kind: int, extra: np.ndarray) -> list[tuple]:
        """One row for each bucket; ``extra``: a flag or a number of each value."""
        pack = np.packbits if extra.dtype == bool else lambda x: x
        return [
            (int(bucket), block, kind, self.value[low:high].tobytes(), pack(extra[low:high]).tobytes())
            for bucket, low, high in zip(self.used, self.cuts[:-1], self.cuts[1:])]

    def answered(self, answers: pa.Table, kind: int) -> np.ndarray:
        """The bit of each distinct value, from the rows of ``_MARKS``."""
        kinds = answers.column("kind").to_pylist()
        marks = {
            b: m for k, b, m in zip(kinds, answers.column("bucket").to_pylist(), answers.column("marks").to_pylist())
            if k == kind}
        return np.concatenate([np.zeros(0, np.uint8), *(
            np.unpackbits(np.frombuffer(marks[int(b)], np.uint8), count=int(high - low))
            for b, low, high in zip(self.used, self.cuts[:-1], self.cuts[1:]))]).astype(bool)


def _sent(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(_SENT)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT)], schema=_SENT)


def _marks(table: pa.Table) -> pa.Table:
    """A bucket's answers to all blocks: which runs and windows occur twice, and which anchors
    leave windows open."""
    out = []
    for kind in sorted(set(table.column("kind").to_pylist())):
        rows = table.filter(pc.equal(table.column("kind"), kind))
        packed, extra = rows.column("values").to_pylist(), rows.column("extra").to_pylist()
        sizes = [len(v) // 8 for v in packed]
        value = np.frombuffer(b"".join(packed), np.uint64)
        order = np.lexsort((np.repeat(rows.column("block").to_numpy(), sizes), value))
        same = value[order][1:] == value[order][:-1]
        group = np.cumsum(np.concatenate([[0], ~same]))
        if kind == ANCHORS:
            run = np.frombuffer(b"".join(extra), np.uint64)[order]
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            low, high = np.minimum.reduceat(run, starts), np.maximum.reduceat(run, starts)
            good = (low == 0) | (low != high)
        else:
            twice = np.concatenate([
                np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(extra, sizes)])[order]
            good = np.bincount(group, weights=twice) + (np.bincount(group) > 1) > 0
        answers = [(kind, good[group])]
        if kind == RUNS:  # the first block that has it, whatever the order of the rows
            answers.append((LEADS, np.concatenate([[True], ~same])))
        cuts = np.cumsum([0, *sizes])
        for name, found in answers:
            answer = np.empty(len(value), bool)
            answer[order] = found
            out.append(pa.Table.from_arrays([
                rows.column("block"), rows.column("bucket"), pa.array(np.full(len(rows), name, np.int32)),
                pa.array([np.packbits(answer[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
            ], schema=_MARKS))
    return pa.concat_tables(out)


def _stretches(first: np.ndarray, stop: np.ndarray, width: int, most: int) -> Iterator[list[tuple[int, int]]]:
    """Adjoining runs joined and dealt into parts of about ``most`` bytes."""
    part, size = [], 0
    starts = np.flatnonzero(np.concatenate([[True], first[1:] != stop[:-1]])) if len(first) else []
    for a, b in zip(first[starts].tolist(), stop[np.append(starts[1:], len(first)) - 1].tolist() if len(first) else []):
        while a < b:
            c = min(b, a + max(most - size - width, 1))
            part.append((a, c))
            size, a = size + c - a + width, c
            if size >= most:
                yield part
                part, size = [], 0
    if part:
        yield part


def equal_windows(raw: np.ndarray, part: list[tuple[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The part's windows in the order of its suffix array, and the number of each one's class."""
    sizes = np.array([b - a for a, b in part])
    lengths = sizes + width - 1
    begins = np.cumsum(lengths + 1) - lengths
    symbols = np.zeros(int(begins[-1] + lengths[-1]) + 1, np.int64)
    place = np.full(len(symbols), -1, np.int64)
    for (a, b), at, n in zip(part, begins.tolist(), lengths.tolist()):
        symbols[at : at + n] = raw[a : a + n]
        symbols[at : at + n] += 1
        place[at : at + b - a] = np.arange(a, b)
    order = place[suffix_array(symbols)]
    order = order[order >= 0]
    same = np.zeros(len(order), bool)
    every = np.lib.stride_tricks.sliding_window_view(raw, width)
    likely = np.flatnonzero(raw[order[1:]] == raw[order[:-1]]) + 1
    for probe in (width // 3, width // 2, width - 1):
        likely = likely[raw[order[likely] + probe] == raw[order[likely - 1] + probe]]
    for low in range(0, len(likely), 1 << 13):
        k = likely[low : low + (1 << 13)]
        same[k] = (every[order[k]] == every[order[k - 1]]).all(axis=1)
    return order, np.cumsum(~same) - 1


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int | None = None,
) -> DataFrame:
    """``(row, n_bytes, n_removed, n_spans, kept, removed)``: the document's other columns, the
    bytes that are left, and the spans of bytes that went."""
    gram = gram or max(1, 2 * width // 3)
    others = [F.col(c) for c in docs.columns if c != text_col]
    chosen = docs.select(
        F.struct(*others).alias("row"), F.col(text_col).cast("string").alias("text"))
    total = int(chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks = total // BLOCK_BYTES + 1
    # On average a run is half as long as a window has grams, and sends two values.
    buckets = total * 4 // max(1, width - gram) // BUCKET_VALUES + 1
    window_buckets = total // BUCKET_VALUES // 4 + 1
    dealt = chosen.withColumn(
        "block", F.pmod(F.xxhash64(f"row.{id_col}", "text"), F.lit(blocks)).cast("int"))

    def first(table: pa.Table) -> pa.Table:
        found = _Runs(table.column("text"), width, gram, buckets, True)
        block, anchors = table.column("block")[0].as_py(), found.anchors
        several = np.zeros(len(anchors), bool)
        several[anchors.number[found.several]] = True
        one = found.value[anchors.first] | np.uint64(1)
        several[anchors.number[(found.value | np.uint64(1)) != one[anchors.number]]] = True
        return _sent([
            *anchors.rows(block, ANCHORS, np.where(several, np.uint64(0), one)),
            *found.runs.rows(block, RUNS, found.runs.twice)])

    def second(table: pa.Table, answers: pa.Table) -> pa.Table:
        found = _Runs(table.column("text"), width, gram, buckets)
        chosen, copied = found.opened(answers)
        at, bucket, value = found.windows(chosen, window_buckets)
        again = np.repeat(copied[chosen], (found.stop - found.first)[chosen])
        kept = [(np.zeros(0, np.int64), np.zeros(0, bool))]
        for part in _stretches(found.first[chosen], found.stop[chosen], width, PART):
            order, number = equal_windows(found.raw, part, width)
            own = np.searchsorted(at, order)
            begins = np.flatnonzero(np.diff(number, prepend=-1))
            twice = np.logical_or.reduceat(again[own], begins) | (np.diff(np.append(begins, len(own))) > 1)
            kept.append((own[begins], twice))
        own, twice = map(np.concatenate, zip(*kept))
        classes = _Distinct(bucket[own], value[own])
        flags = classes.twice.copy()
        flags[classes.number[twice]] = True
        return _sent(classes.rows(table.column("block")[0].as_py(), WINDOWS, flags))

    def third(table: pa.Table, answers: pa.Table) -> pa.Table:
        found = _Runs(table.column("text"), width, gram, buckets)
        chosen, copied = found.opened(answers)
        at, bucket, value = found.windows(chosen, window_buckets)
        windows = _Distinct(bucket, value)
        hits = at[windows.answered(answers, WINDOWS)[windows.number]]
        steps = np.zeros(len(found.raw) + 1, np.int32)
        steps[hits] += 1  # no place is twice in one of the four
        steps[hits + width] -= 1
        steps[found.first[copied]] += 1
        steps[found.stop[copied] + width - 1] -= 1
        return _cut(table.column("row").take(found.order), found, np.cumsum(steps[:-1]) > 0)

    def _cut(rows: pa.ChunkedArray, found: _Runs, gone: np.ndarray) -> pa.Table:
        offsets, n = found.offsets, len(gone)
        edge = np.zeros(n, bool)
        edge[offsets[:-1][offsets[:-1] < n]] = True  # a text's first byte
        begins, ends = gone.copy(), gone.copy()
        if n:
            begins[1:] &= ~gone[:-1] | edge[1:]
            ends[:-1] &= ~gone[1:] | edge[1:]
        first, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        spans_before = np.searchsorted(first, offsets)
        own = np.repeat(offsets[:-1], np.diff(spans_before))
        left_before = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        left = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(rows),
            [None, pa.py_buffer(left_before.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(found.raw[~gone]))])
        spans = pa.ListArray.from_arrays(
            pa.array(spans_before.astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array((first - own).astype(np.int32)), pa.array((stop - own).astype(np.int32))], ["start", "stop"]))
        sizes = np.diff(offsets)
        return pa.Table.from_arrays(
            [rows, pa.array(sizes), pa.array(sizes - np.diff(left_before)),
             pa.array(np.diff(spans_before).astype(np.int64)), left.cast(pa.binary()), spans],
            ["row", "n_bytes", "n_removed", "n_spans", "kept", "removed"])

    by_block = dealt.groupBy("block")
    runs = by_block.applyInArrow(first, _SENT_DDL).groupBy("bucket").applyInArrow(_marks, _MARKS_DDL)
    windows = (
        by_block.cogroup(runs.groupBy("block")).applyInArrow(second, _SENT_DDL)
        .groupBy("bucket").applyInArrow(_marks, _MARKS_DDL))
    out = StructType([chosen.schema["row"], *StructType.fromDDL(_JUDGED)])
    return by_block.cogroup(runs.unionAll(windows).groupBy("block")).applyInArrow(third, out)


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
) -> DataFrame:
    """The documents with all their columns, and what is left of their text; bytes that are no
    longer whole characters become U+FFFD."""
    left = remove_repeats(docs, id_col, text_col, width)
    text = F.decode("kept", "UTF-8")
    return left.select(*(
        text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
