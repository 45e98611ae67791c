"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full sets.

A document's set is its distinct word shingles. Two collections of ``tables`` short keys
are made, each key from ``rows`` minhashes; table (i, j) is keyed by key i of the first
with key j of the second. So ``tables ** 2`` tables of ``2 * rows`` minhashes each cost
``2 * tables * rows`` minhashes in all. At the defaults a pair of similarity 0.8 meets in
some table with probability (1 - (1 - 0.8**2)**9)**2 = 0.9998, more similar ones surely.

Documents of equal sets form one class first, so copies cost one row each from there on.
In each bucket all classes are paired with one centre: linear, however large the bucket.
Pairs that cannot be similar enough by their sizes and sketches (the smallest hash of each of
about as many ranges as the set has members) go: a bound, no estimate. The others are
confirmed on whole sets. Buckets that still hold several components are dealt into blocks that
meet two by two. There each pair is looked at in the first table that both its classes share;
members that the bound leaves a partner bring their texts to the same block, where pairs are
confirmed, nearest first, and only a spanning forest of links leaves the task. So no pair that
meets in a bucket is left out unless it is in one component already, and no task emits more
rows than it has members.

Null or empty text, or text without words, has an empty set and links with nothing. A row
without id links with nothing either: its component is null and it is kept. Rows with the
same id are one document with several texts; ``one_of_each`` takes them for documents of
their own, unless their texts are equal. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicesync.llm.batches import slices, words_of
from slicesync.llm.components import components
from slicesync.llm.hashing import BASES, inner_windows, mixed, window_hashes, word_hashes
from slicesync.session import stage

SHINGLE = 5
PERCENT = 80
TABLES = 9
ROWS = 2
#: Fewest bins of a sketch: the smallest hash of each of so many ranges of hashes, as one byte.
BINS = 64
#: Most members of a block, and shingles of them; a task compares two blocks of a bucket at once.
CHUNK = 4096
CHUNK_SHINGLES = 1 << 20
#: Members that are compared with a block's at once.
TILE = 64
SIGNED = (
    "doc_id long, text_hash long, n_shingles long, digest binary, first array<long>, "
    "second array<long>, sketch binary")


class Sets:
    """Distinct shingle hashes of each text, one after another, sorted within a text."""

    def __init__(self, texts: pa.Array, width: int):
        codes, offsets, words = words_of(texts, lower=True)
        hashes = word_hashes(words)[codes, 0]
        inner = np.flatnonzero(inner_windows(offsets, width))
        counts = np.diff(offsets)
        values = window_hashes(hashes, width, BASES[0])[inner]
        owner = np.repeat(np.arange(len(counts)), counts)[inner]
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            whole = [_sequence(hashes[offsets[i] : offsets[i + 1]]) for i in short]
            values = np.concatenate([values, np.array(whole, np.uint64)])
            owner = np.concatenate([owner, short])
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        self.values = values[fresh]
        self.offsets = np.searchsorted(owner[fresh], np.arange(len(counts) + 1))

    def __getitem__(self, at: int) -> np.ndarray:
        return self.values[self.offsets[at] : self.offsets[at + 1]]


def _sequence(hashes: np.ndarray) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(hashes)))


def _minhashes(sets: Sets, count: int) -> np.ndarray:
    """Shape (count, sets that are not empty); the multipliers are fixed by the rule below."""
    full = np.flatnonzero(np.diff(sets.offsets))
    starts = sets.offsets[full]
    out = np.zeros((count, len(full)), np.uint64)
    if len(full):
        seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64)).reshape(count, 2)
        for i, (factor, shift) in enumerate(seeds):
            out[i] = np.minimum.reduceat((sets.values ^ shift) * (factor | np.uint64(1)), starts)
    return out


def _bins(sizes: np.ndarray) -> np.ndarray:
    """The power of two that a set's size does not exceed, ``BINS`` at least."""
    return np.maximum(BINS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))


def _sketches(sets: Sets) -> list[bytes]:
    """Of each set that is not empty: a byte of each bin's smallest hash, 0 if none. Hashes are
    sorted, so a bin's smallest is the first that begins with its number."""
    counts = np.diff(sets.offsets)
    bins = _bins(counts) * (counts > 0)
    ends = np.cumsum(bins)
    shift = (64 - np.log2(np.maximum(bins, 1))).astype(np.uint64)
    place = np.repeat(ends - bins, counts) + (sets.values >> np.repeat(shift, counts)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[place[first]] = 1 + sets.values[first] % np.uint64(254)
    return [out[b - n : b].tobytes() for b, n in zip(ends.tolist(), bins.tolist()) if n]


def _folded(sketches: np.ndarray, bins: int) -> np.ndarray:
    """Rows of sketches as they would be with fewer bins."""
    while sketches.shape[1] > bins:
        even, odd = sketches[:, ::2], sketches[:, 1::2]
        sketches = np.where(even != 0, even, odd)
    return sketches


def _unlike(left: bytes, right: bytes) -> int:
    """How many bins differ, at the smaller number of bins."""
    a, b = (np.frombuffer(x, np.uint8)[None, :] for x in (left, right))
    bins = min(a.shape[1], b.shape[1])
    return int((_folded(a, bins) != _folded(b, bins)).sum())


def _possible(differ: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b may be similar enough if so many bins of their sketches
    differ. Each such bin has a hash that only one of the sets holds, and no two bins share
    one, so what the sets have in common is bounded: no pair that is similar enough goes."""
    both = np.minimum((a + b - differ) // 2, np.minimum(a, b))
    return 100 * both >= percent * (a + b - both)


def _keys(hashes: np.ndarray) -> np.ndarray:
    """Rows of minhashes combined into one 64-bit key each, shape (keys, sets)."""
    out = np.zeros(hashes.shape[1:], np.uint64)
    for row in range(hashes.shape[0]):
        out = mixed(out + hashes[row] + np.uint64(row + 1))
    return out


def signatures(chosen: DataFrame, shingle: int, tables: int, rows: int) -> DataFrame:
    """Set size, digest of the set, the two key collections and a sketch of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = Sets(part.column("text"), shingle)
            sizes = np.diff(sets.offsets)
            found = _minhashes(sets, 2 * tables * rows)
            halves = [
                _keys(np.moveaxis(h.reshape(tables, rows, -1), 1, 0))
                for h in (found[: tables * rows], found[tables * rows :])]
            sketch = _sketches(sets)
            full = np.concatenate([[0], np.cumsum(sizes > 0)])
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("text_hash"), pa.array(sizes),
                pa.array([xxhash.xxh3_128_digest(sets[i].tobytes()) if n else None
                          for i, n in enumerate(sizes)], pa.binary()),
                *(pa.ListArray.from_arrays(
                    pa.array((full * tables).astype(np.int32)),
                    pa.array(np.ascontiguousarray(h.T).reshape(-1).view(np.int64))) for h in halves),
                pa.array([sketch[k] if n else None for k, n in zip(full[:-1], sizes)], pa.binary()),
            ], ["doc_id", "text_hash", "n_shingles", "digest", "first", "second", "sketch"])

    return chosen.mapInArrow(sign, SIGNED)


def _table_keys(classes: DataFrame) -> DataFrame:
    """``(cls, table, key)``: the keys of all tables, each a pair of the two collections."""
    pairs = F.flatten(F.transform("first", lambda x, i: F.transform(
        "second", lambda y, j: F.xxhash64(x, y, i, j))))
    return classes.select("cls", F.posexplode(pairs).alias("table", "key"))


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that may be similar enough by their sizes and sketches."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unlike = np.array(list(map(_unlike, *(batch.column(c).to_pylist() for c in ("left", "right")))), np.int64)
            sizes = (batch.column(c).to_numpy() for c in ("m", "n"))
            good = _possible(unlike, *sizes, percent)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = (
        pairs.join(classes.select(F.col("cls").alias("a"), F.col("sketch").alias("left"), F.col("n_shingles").alias("m")), "a")
        .join(classes.select(F.col("cls").alias("b"), F.col("sketch").alias("right"), F.col("n_shingles").alias("n")), "b"))
    return joined.select("a", "b", "left", "right", "m", "n").mapInArrow(similar, "a long, b long")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether whole sets, as sorted hashes, are similar enough."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough. ``texts``: (cls, text)."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(slices(batches, "left"), "right"):
            left, right = (Sets(part.column(c), shingle) for c in ("left", "right"))
            linked = [_linked(left[i], right[i], percent) for i in range(part.num_rows)]
            yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    joined = (
        pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("left")), "a")
        .join(texts.select(F.col("cls").alias("b"), F.col("text").alias("right")), "b"))
    return joined.select("a", "b", "left", "right").mapInArrow(confirm, "a long, b long")


def _first_table(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first table that each two classes share: the first key of either collection that is
    the same. Shape (left, right)."""
    found = []
    for a, b in zip(left, right):
        at = np.full((len(a), len(b)), a.shape[1], np.int16)
        for i in range(a.shape[1] - 1, -1, -1):
            at[a[:, i][:, None] == b[:, i][None, :]] = i
        found.append(at)
    return found[0] * left[1].shape[1] + found[1]


def _differing(left: np.ndarray, right: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen pairs, and how many bins of their sketches differ."""
    x, y = np.nonzero(chosen)
    if 8 * len(x) > chosen.size:  # most of them: whole rows of bins at once
        unlike = np.zeros(chosen.shape, np.int32)
        for low in range(0, left.shape[1], 255):
            some = np.zeros(chosen.shape, np.uint8)
            for a, b in zip(left.T[low : low + 255], right.T[low : low + 255]):
                some += a[:, None] != b[None, :]
            unlike += some
        return x, y, unlike[x, y]
    step = max(1, (1 << 22) // left.shape[1])
    parts = [(left[x[k : k + step]] != right[y[k : k + step]]).sum(axis=1) for k in range(0, len(x), step)]
    return x, y, np.concatenate([np.zeros(0, np.int64), *parts])


def _possible_pairs(group: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of members of different components, by place in the group, that their sketches leave
    possible, and how much of a sketch differs; each pair in the first table it shares only."""
    part, sizes = (group.column(c).to_numpy() for c in ("component", "n_shingles"))
    sketch = group.column("sketch").to_pylist()
    keys = [np.array(group.column(c).to_pylist(), np.int64) for c in ("first", "second")]
    table, bins = group.column("table")[0].as_py(), np.array(list(map(len, sketch)))
    sides = [group.column(c).to_numpy() for c in ("left", "right")]
    (left, right), itself = map(np.flatnonzero, sides), sides[0] & sides[1]
    of = {n: np.frombuffer(b"".join(sketch[i] for i in np.flatnonzero(bins == n)), np.uint8).reshape(-1, n)
          for n in np.unique(bins).tolist()}
    row = np.zeros(len(bins), np.int64)  # place among the sketches of its size
    for n in of:
        row[bins == n] = np.arange(len(of[n]))
    for m in of:
        for n in of:
            probes, others = left[bins[left] == m], right[bins[right] == n]
            # A set is less than half as large as its bins are many only if those are the fewest.
            if not len(probes) or not len(others) or 200 * min(m, n) < percent * max(m, n):
                continue
            b = _folded(of[n][row[others]], min(m, n))
            for low in range(0, len(probes), TILE):
                probe = probes[low : low + TILE]
                chosen = (part[probe][:, None] != part[others][None, :]) & (
                    _first_table(*([k[at] for k in keys] for at in (probe, others))) == table)
                if m >= n:  # where a block meets itself, each pair once
                    again = itself[probe][:, None] & itself[others][None, :]
                    chosen &= ~(again & (probe[:, None] > others[None, :])) if m == n else ~again
                x, y, unlike = _differing(_folded(of[m][row[probe]], min(m, n)), b, chosen)
                good = _possible(unlike, sizes[probe[x]], sizes[others[y]], percent)
                yield probe[x[good]], others[y[good]], unlike[good] / min(m, n)


_MEMBER = "key long, chunk long, cls long"


def _suspects(members: DataFrame, percent: int) -> DataFrame:
    """The members of blocks that have a possible partner there."""

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            found = np.zeros(len(group), bool)
            for x, y, _ in _possible_pairs(group, percent):
                found[x] = found[y] = True
            if found.any():
                yield from group.select(["key", "chunk", "cls"]).filter(pa.array(found)).combine_chunks().to_batches()

    return _by_block(members).mapInArrow(suspect, _MEMBER)


def _forest(members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between members of blocks that have their texts with them: a spanning forest of
    each block's components."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            cls, part = (group.column(c).to_pylist() for c in ("cls", "component"))
            sets, name, links = Sets(group.column("text"), shingle), {p: p for p in part}, []

            def root(p: int) -> int:
                while name[p] != p:
                    name[p] = p = name[name[p]]
                return p

            for x, y, unlike in _possible_pairs(group, percent):
                for at in np.argsort(unlike, kind="stable").tolist():
                    i, j = int(x[at]), int(y[at])
                    a, b = root(part[i]), root(part[j])
                    if a != b and _linked(sets[i], sets[j], percent):
                        name[a] = b
                        links.append((cls[i], cls[j]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    return _by_block(members).mapInArrow(link, "a long, b long")


def _by_block(members: DataFrame) -> DataFrame:
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(tasks, "key", "chunk").sortWithinPartitions("key", "chunk")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of one bucket and chunk; at most one run and one batch are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key, chunk = batch.column("key").to_numpy(), batch.column("chunk").to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for low, high in zip(bounds[:-1], bounds[1:]):
            if held and low == 0 and high and (key[0], chunk[0]) != (
                held[-1].column("key")[0].as_py(), held[-1].column("chunk")[0].as_py()):
                yield pa.Table.from_batches(held)
                held = []
            if low:
                yield pa.Table.from_batches(held)
                held = []
            if high > low:
                held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _unsettled(met: DataFrame, names: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of buckets with several components. What is outside a bucket's main component
    is dealt into blocks, and so is the main component; each block of the first kind meets
    each block of either kind once, so a group holds two blocks, however large the bucket."""
    parts = met.select("key", "table", "cls").join(
        names.withColumnRenamed("node", "cls"), "cls", "left"
    ).withColumn("component", F.coalesce("component", "cls")).join(classes.select("cls", "n_shingles"), "cls")
    split = (
        parts.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
        .groupBy("key").agg(
            F.max_by("component", "n").alias("main"), F.max(F.struct("n", "size")).alias("most"),
            F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("parts")).where("parts > 1"))

    def blocks_for(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / CHUNK, size / CHUNK_SHINGLES)).cast("int")

    split = split.select(
        "key", "main", blocks_for(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("outer"),
        blocks_for(F.col("most.n"), F.col("most.size")).alias("inner"))
    outside, blocks = F.col("component") != F.col("main"), F.col("outer") + F.col("inner")
    mine = F.when(outside, F.pmod(F.xxhash64("cls"), "outer")).otherwise(
        F.col("outer") + F.pmod(F.xxhash64("cls"), "inner")).cast("int")
    dealt = parts.join(split, "key").withColumn("mine", mine).withColumn("other", F.explode(
        F.sequence(F.lit(0), F.when(outside, blocks).otherwise(F.col("outer")) - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return dealt.select(
        "key", (low.cast("long") * blocks + high).alias("chunk"), "table", "cls", "component",
        (F.col("mine") == low).alias("left"), (F.col("mine") == high).alias("right"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
    percent: int = PERCENT, tables: int = TABLES, rows: int = ROWS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``."""
    signed, classes, names = _found(docs, id_col, text_col, shingle, percent, tables, rows, by_id=True)
    return _labelled(signed, classes, names)


def _found(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, tables: int, rows: int, by_id: bool,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures, classes and the components' names; ``by_id`` links the texts of an id."""
    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    signed = stage(signatures(chosen, shingle, tables, rows), "signatures")
    known = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    grouped = known.groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("row"), F.any_value("first").alias("first"),
        F.any_value("second").alias("second"), F.any_value("sketch").alias("sketch"),
        F.any_value("n_shingles").alias("n_shingles"))
    classes = stage(
        grouped.select("digest", "row.*", "first", "second", "sketch", "n_shingles",
                       F.monotonically_increasing_id().alias("cls")), "classes")
    keys = _table_keys(classes)
    # Buckets of the same members, as similar documents fill them in table after table, are
    # one bucket: members are told by their number, ends and two 64-bit hashes.
    buckets = keys.groupBy("key").agg(
        F.min("cls").alias("centre"), F.max("cls").alias("last"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"),
        F.min("table").alias("table")).where("n > 1")
    # The first of their tables stands for them: what two members share first, all of them share.
    buckets = buckets.groupBy("centre", "last", "n", "x", "y").agg(F.min(F.struct("table", "key")).alias("least"))
    met = stage(keys.drop("table").join(buckets.select("least.*", "centre"), "key"), "met")
    texts = stage(_texts(chosen, classes.join(met.select("cls").distinct(), "cls", "left_semi")), "texts")
    likely = _agreeing(
        met.where("cls <> centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct(),
        classes, percent)
    links = _confirmed(likely, texts, shingle, percent)
    links = stage(links.unionAll(_same_id(known, classes)) if by_id else links, "links")
    names = components(links)
    members = stage(_unsettled(met, names, classes), "members")
    compared = classes.select("cls", "n_shingles", "sketch", "first", "second")
    found = stage(_suspects(members.join(compared, "cls"), percent), "suspects")
    more = stage(_forest(
        members.join(found, ["key", "chunk", "cls"]).join(compared, "cls").join(texts, "cls"), shingle, percent), "links")
    if not more.isEmpty():
        names = components(links.unionAll(more))
    return signed, classes, names


def _texts(chosen: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text for each wanted class, of the row that stands for it; no shuffle but the join's."""
    keys = ["doc_id", "text_hash"]
    return wanted.select("cls", *keys).join(chosen, keys).groupBy(*keys, "cls").agg(
        F.any_value("text").alias("text")).select("cls", "text")


def _same_id(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of an id that has several texts."""
    of_doc = known.select("doc_id", "digest").distinct().join(classes.select("digest", "cls"), "digest")
    several = of_doc.groupBy("doc_id").agg(
        F.min("cls").alias("a"), F.max("cls").alias("last")).where("a < last")
    return of_doc.join(several, "doc_id").where("cls <> a").select("a", F.col("cls").alias("b"))


def _labelled(signed: DataFrame, classes: DataFrame, names: DataFrame) -> DataFrame:
    named = classes.select("cls", "digest", "doc_id").join(
        names.withColumnRenamed("node", "cls"), "cls", "left"
    ).withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = named.join(least, "component").select("digest", "component_id")
    out = signed.select("doc_id", "n_shingles", "digest").join(labels, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
    percent: int = PERCENT, tables: int = TABLES, rows: int = ROWS,
) -> DataFrame:
    """The documents, with all their columns, that stay: one row of each group. Rows of one id
    with different texts are documents of their own; rows without id, which link with
    nothing, stay."""
    signed, classes, names = _found(docs, id_col, text_col, shingle, percent, tables, rows, by_id=False)
    row = F.struct("doc_id", "text_hash")
    first = (
        classes.select("cls", row.alias("row")).join(names.withColumnRenamed("node", "cls"), "cls", "left")
        .groupBy(F.coalesce("component", "cls")).agg(F.min("row").alias("row")).select("row.*"))
    alone = signed.where("digest IS NULL AND doc_id IS NOT NULL").select("doc_id", "text_hash")
    keys = [_unused(docs, "row_id"), _unused(docs, "row_text")]
    kept = first.unionAll(alone).select(F.col("doc_id").alias(keys[0]), F.col("text_hash").alias(keys[1]))
    named = docs.where(F.col(id_col).isNotNull()).withColumns({
        keys[0]: F.col(id_col).cast("long"), keys[1]: F.xxhash64(F.col(text_col).cast("string"))})
    # The join has dealt the rows by id and text, so that dropping rows equal in them costs no shuffle.
    stay = named.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)
    return stay.unionAll(docs.where(F.col(id_col).isNull()))


def _unused(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name
