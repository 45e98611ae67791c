"""Divergence of sources by their terms: texts as white-space chunks, each chunk tokenized once.

Documents are dealt into blocks by a hash of their row. A block counts the chunks of each of
its documents and sends each bucket its distinct chunks. The bucket tokenizes each globally
distinct chunk once and answers every block that sent it (nothing where a chunk is its own
term). The block joins the terms back to its documents' chunk counts, so a term of several
chunks of one document is one document's, and counts documents and occurrences for each
language, source and term. These cells travel packed, by a hash of the term; cells of up to
``FAN`` blocks add up at a time, so that a term that all blocks hold stays bounded in a task.

Terms are runs of A-Z, a-z and everything beyond ASCII; A-Z are lower-cased. A language keeps
the terms of at least ``min_docs`` of its documents. All arithmetic is on integers.

A pair of sources is compared over all kept terms without listing those that neither has:
``f(p, q)`` of terms that only one has depends on a count alone, so histograms of counts give
it; what is different where both have it is added up in the task that holds the term's
sources, and only sums for each pair leave a task.

Null text, language and source are ''. A row is a document, whatever its id. No rows give no
rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicesync.llm.batches import gather, plain_text, words_of
from slicesync.session import stage

MIN_DOCS = 10
TOP_TERMS = 10
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: Blocks whose cells add up at a time.
FAN = 1024
#: Pairs of sources that a task looks at, or holds sums of, at once.
PAIRS = 1 << 18
#: A block's distinct chunks are at most about so much of its text, to choose the buckets.
_DISTINCT = 4
_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("chunks", pa.list_(pa.string()))])
_ANSWER = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("terms", pa.list_(pa.string()))])
# Cells of one block and bucket: its terms, its groups, and for each term how many groups hold
# it; then for each of them which group, documents and occurrences.
_CELLS = (
    "bucket int, block int, terms array<string>, langs array<string>, sources array<string>, "
    "held binary, groups binary, docs binary, occurrences binary")
_CELLS_ARROW = pa.schema([
    ("bucket", pa.int32()), ("block", pa.int32()),
    *((n, pa.list_(pa.string())) for n in ("terms", "langs", "sources")),
    *((n, pa.binary()) for n in ("held", "groups", "docs", "occurrences"))])
COUNTS = "lang string, source string, term string, occurrences long, lang_count long"
# Bytes that no term holds become spaces, A-Z lower case; bytes of other characters stay.
_TERM_BYTES = np.array([
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def terms_of(chunks: pa.Array) -> pa.Array:
    """Each chunk lower-cased, with a space in place of each byte that belongs to no term."""
    texts = plain_text(chunks)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return pa.LargeStringArray.from_buffers(
        len(texts), texts.buffers()[1], pa.py_buffer(_TERM_BYTES[raw]), None, 0, texts.offset)


class _Chunks:
    """A block's chunks: of which document, how often, and the distinct ones by bucket."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, buckets: int):
        codes, offsets, self.words = words_of(texts)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        pairs, self.count = np.unique(owner * max(len(self.words), 1) + codes, return_counts=True)
        self.owner, self.code = pairs // max(len(self.words), 1), pairs % max(len(self.words), 1)
        self.bucket = _bucket_of(self.words, buckets)
        # By bucket, then by word: the same order each time a block is read, whose rows come in any.
        self.order = pc.sort_indices(self.words).to_numpy().astype(np.int64)
        self.order = self.order[np.argsort(self.bucket[self.order], kind="stable")]
        self.used, cuts = np.unique(self.bucket[self.order], return_index=True)
        self.cuts = np.append(cuts, len(self.order))


def _bucket_of(words: pa.Array, buckets: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) % buckets for w in words.cast(pa.large_binary()).to_pylist()], np.int32)


def _lists(values: pa.Array, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values.cast(pa.string()))


def _packed(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, which the first byte tells."""
    size = next(n for n in (1, 2, 4, 8) if n == 8 or int(values.max(initial=0)) < 1 << 8 * n)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    """The numbers in the same few bytes; sums of them need more."""
    values = np.frombuffer(packed, f"<u{packed[0]}", offset=1)
    return values.astype(np.int64) if packed[0] == 8 else values


class _Cells:
    """Sums for each term and group, added up over rows of ``_CELLS``."""

    def __init__(self, terms: pa.Array, groups: list[tuple], term, group, docs, occurrences):
        key = term.astype(np.int64) * max(len(groups), 1) + group
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        add = (lambda x: np.add.reduceat(x[order], starts, dtype=np.int64)) if len(key) else (lambda x: x.astype(np.int64))
        self.terms, self.groups = terms, groups
        self.term, self.group = key[starts] // max(len(groups), 1), key[starts] % max(len(groups), 1)
        self.docs, self.occurrences = add(docs), add(occurrences)

    @classmethod
    def of(cls, table: pa.Table) -> _Cells:
        coded = table.column("terms").combine_chunks()
        first = np.append(0, np.cumsum(pc.list_value_length(coded).to_numpy()))
        coded = coded.flatten().dictionary_encode()
        number, names = {}, []
        parts: list[list[np.ndarray]] = [[], [], [], []]
        rows = zip(*(table.column(c).to_pylist() for c in ("langs", "sources", "held", "groups", "docs", "occurrences")))
        for k, (langs, sources, held, groups, docs, occurrences) in enumerate(rows):
            for name in zip(langs, sources):
                if name not in number:
                    number[name] = len(names)
                    names.append(name)
            own = np.array([number[x] for x in zip(langs, sources)], np.int32)
            codes = coded.indices.slice(first[k], first[k + 1] - first[k]).to_numpy()
            parts[0].append(np.repeat(codes, _unpacked(held)))
            parts[1].append(own[_unpacked(groups)])
            parts[2].append(_unpacked(docs))
            parts[3].append(_unpacked(occurrences))
        del rows
        return cls(coded.dictionary, names, *map(np.concatenate, parts))

    def rows(self, block: int, buckets: int) -> pa.Table:
        """One row for each bucket of terms."""
        bucket = _bucket_of(self.terms, buckets)
        own = bucket[self.term]
        order = np.argsort(own, kind="stable")
        out = []
        used, cuts = np.unique(own[order], return_index=True)
        for number, at in zip(used.tolist(), np.split(order, cuts[1:])):
            starts = np.flatnonzero(np.diff(self.term[at], prepend=-1))
            groups, group = np.unique(self.group[at], return_inverse=True)
            names = [self.groups[g] for g in groups]
            out.append((
                number, block, self.terms.take(pa.array(self.term[at][starts])).to_pylist(),
                [x for x, _ in names], [x for _, x in names], _packed(np.diff(np.append(starts, len(at)))),
                _packed(group), _packed(self.docs[at]), _packed(self.occurrences[at])))
        columns = list(zip(*out)) if out else [()] * len(_CELLS_ARROW)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CELLS_ARROW)], schema=_CELLS_ARROW)

    def kept(self, least: int) -> pa.Table:
        """Rows of ``COUNTS``: the terms that ``least`` documents of their language hold."""
        langs, lang_of = np.unique(np.array([x for x, _ in self.groups], object), return_inverse=True)
        key = self.term * max(len(langs), 1) + lang_of[self.group] if len(self.term) else self.term
        _, own = np.unique(key, return_inverse=True)
        docs, total = (np.zeros(len(own), np.int64) for _ in range(2))
        np.add.at(docs, own, self.docs)
        np.add.at(total, own, self.occurrences)
        at = np.flatnonzero(docs[own] >= least)
        names = [pa.array([x[k] for x in self.groups], pa.string()).take(pa.array(self.group[at])) for k in (0, 1)]
        return pa.Table.from_arrays(
            [*names, self.terms.cast(pa.string()).take(pa.array(self.term[at])),
             pa.array(self.occurrences[at]), pa.array(total[own[at]])],
            ["lang", "source", "term", "occurrences", "lang_count"])


def term_counts(docs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """``COUNTS`` of documents ``(lang, source, text)``: occurrences of each kept term in each
    group that has it, and in the language."""
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks, buckets = total // BLOCK_BYTES + 1, total // _DISTINCT // BUCKET_BYTES + 1
    # Equal rows are dealt over all blocks by their place in the input.
    dealt = docs.withColumn("block", F.pmod(
        F.xxhash64("text", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))

    def chunks(table: pa.Table) -> pa.Table:
        found = _Chunks(table.column("text"), buckets)
        n = len(found.used)
        return pa.Table.from_arrays([
            pa.array(found.used, pa.int32()), pa.repeat(table.column("block")[0], n),
            _lists(found.words.take(pa.array(found.order)), found.cuts)], schema=_SENT)

    def tokenized(table: pa.Table) -> pa.Table:
        sent = table.column("chunks").combine_chunks()
        coded = sent.flatten().dictionary_encode()
        terms = terms_of(coded.dictionary).cast(pa.string())
        changed = pc.if_else(pc.equal(terms, coded.dictionary), pa.scalar(None, pa.string()), terms)
        sizes = pc.list_value_length(sent).to_numpy()
        return pa.Table.from_arrays([
            table.column("bucket"), table.column("block"),
            _lists(changed.take(coded.indices), np.append(0, np.cumsum(sizes)))], schema=_ANSWER)

    def joined(table: pa.Table, answers: pa.Table) -> pa.Table:
        found = _Chunks(table.column("text"), buckets)
        answer = answers.sort_by("bucket").column("terms").combine_chunks().flatten()
        answer = pc.coalesce(answer, found.words.take(pa.array(found.order)).cast(pa.string()))
        codes, offsets, terms = words_of(answer)  # the terms of each distinct chunk
        del answer
        place = np.empty(len(found.order), np.int64)
        place[found.order] = np.arange(len(found.order))
        at = place[found.code]
        sizes = offsets[at + 1] - offsets[at] if len(at) else at
        term = codes[gather(offsets[at], sizes)] if len(at) else at
        n_terms = max(len(terms), 1)
        count, term = np.repeat(found.count, sizes), np.repeat(found.owner, sizes) * n_terms + term
        del found, codes, offsets, place, at, sizes
        pair, own = np.unique(term, return_inverse=True)
        del term
        times = np.zeros(len(pair), np.int64)
        np.add.at(times, own, count)
        del own, count
        number: dict[tuple, int] = {}
        group = np.array([
            number.setdefault(x, len(number)) for x in zip(*(table.column(c).to_pylist() for c in ("lang", "source")))],
            np.int64)
        cells = _Cells(
            terms, list(number), pair % n_terms, group[pair // n_terms], np.ones(len(pair), np.int64), times)
        return cells.rows(table.column("block")[0].as_py(), buckets)

    def added(table: pa.Table) -> pa.Table:
        cells = _Cells.of(table)
        return cells.rows(table.column("block")[0].as_py() // FAN, 1).set_column(
            0, "bucket", pa.array([table.column("bucket")[0].as_py()], pa.int32()))

    by_block = dealt.groupBy("block")
    answers = (
        by_block.applyInArrow(chunks, "bucket int, block int, chunks array<string>")
        .groupBy("bucket").applyInArrow(tokenized, "bucket int, block int, terms array<string>"))
    cells = by_block.cogroup(answers.groupBy("block")).applyInArrow(joined, _CELLS)
    while blocks > FAN:
        cells = cells.groupBy("bucket", F.floor(F.col("block") / FAN)).applyInArrow(added, _CELLS)
        blocks = -(-blocks // FAN)
    return cells.groupBy("bucket").applyInArrow(lambda table: _Cells.of(table).kept(least), COUNTS)


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column | str, total: str, kept: str) -> Column:
    """``1 + floor(10**9 * (count + 2) / (total + 2 * kept))`` in 64 bits; null if nothing is kept."""
    of = F.col(total) + 2 * F.col(kept)
    head = ((F.col(count) if isinstance(count, str) else count) + 2) * 100_000
    share = _whole(head, of) * 10_000 + _whole((head % of) * 10_000, of) + 1
    return F.when(F.col(kept) > 0, share)


def _differ(p: str, q: str) -> Column:
    """``floor((p - q)**2 / (p + q))``"""
    apart = F.col(p) - F.col(q)
    return _whole(apart * apart, F.col(p) + F.col(q))


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_docs: int = MIN_DOCS, top: int = TOP_TERMS,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each group's distance to the other sources of
    its language (``pair``), and the terms it has most above its language (``term``)."""
    chosen = docs.select(*(
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
        for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = stage(term_counts(chosen, min_docs), "term-counts")
    langs = counts.groupBy("lang", "term").agg(F.any_value("lang_count").alias("lang_count")).groupBy("lang").agg(
        F.sum("lang_count").alias("lang_total"), F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("occurrences").alias("total"), F.count("*").alias("held"))
    groups = stage(
        chosen.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left").na.fill(0, ["total", "held", "lang_total", "kept"])
        .withColumn("none", _share(F.lit(0), "total", "kept")), "groups")
    cells = stage(
        counts.join(groups, ["lang", "source"])
        .withColumn("p", _share("occurrences", "total", "kept"))
        .withColumn("q", _share("lang_count", "lang_total", "kept"))
        .select("lang", "source", "term", "p", "q", "none"), "cells")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order).cast("int").alias("rank")
    terms = cells.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _differ("p", "q").alias("value"))
    pairs = _pairs(groups, cells).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select("*", ranked).select(columns).unionAll(
        terms.select("*", ranked).where(F.col("rank") <= top).select(columns))


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each two sources, over the task's terms that both have: how far ``f`` is from what it
    would be if the term were in one of them only, for either of them, and in neither."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    sums: dict[tuple, int] = {}
    for batch in batches:
        lists = batch.column("held")
        rows = lists.flatten()
        names = pc.dictionary_encode(rows.field("source"))
        langs = pc.dictionary_encode(batch.column("lang"))
        code, p, none = (x.to_numpy().astype(np.int64) for x in (names.indices, rows.field("p"), rows.field("none")))
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        stop = np.repeat(np.cumsum(sizes), sizes)
        lang = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes)
        later = stop - np.arange(len(stop)) - 1  # the sources that come after in the same list
        ends, n = np.cumsum(later), len(names.dictionary)
        first = 0
        while first < len(stop):  # so many pairs at once
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
            a = np.repeat(np.arange(first, last), later[first:last])
            b = gather(np.arange(first, last) + 1, later[first:last])
            low, high = np.minimum(code[a], code[b]), np.maximum(code[a], code[b])
            value = f(p[a], p[b]) - f(p[a], none[b]) - f(none[a], p[b]) + f(none[a], none[b])
            key, own = np.unique((lang[a] * n + low) * n + high, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, own, value)
            for k, v in zip(key.tolist(), total.tolist()):
                x, y = sorted((names.dictionary[k // n % n].as_py(), names.dictionary[k % n].as_py()), key=str.encode)
                at = (langs.dictionary[k // n // n].as_py(), x, y)
                sums[at] = sums.get(at, 0) + v
            first = last
        if len(sums) > PAIRS:
            yield _sums(sums)
            sums = {}
    if sums:
        yield _sums(sums)


def _sums(sums: dict[tuple, int]) -> pa.RecordBatch:
    columns = [*zip(*sums), list(sums.values())]
    return pa.RecordBatch.from_arrays(
        [pa.array(c) for c in columns], ["lang", "source_a", "source_b", "value"])


def _pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for each two sources of a language, both ways."""

    def side(df: DataFrame, end: str, *columns: str) -> DataFrame:
        return df.select("lang", *(F.col(c).alias(f"{c}_{end}") for c in ("source", *columns)))

    # A term that only one has: the same for all terms of one count.
    levels = cells.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    alone = (
        side(levels, "a", "p", "n").join(side(groups, "b", "none"), "lang").where("source_a <> source_b")
        .select("lang", F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b"),
                (F.col("n_a") * _differ("p_a", "none_b")).alias("value")))
    # What is different where both have the term; a list is as long as the term has sources.
    held = F.collect_list(F.struct("source", "p", "none")).alias("held")
    both = cells.groupBy("lang", "term").agg(held).select("lang", "held").mapInArrow(
        _both, "lang string, source_a string, source_b string, value long")
    # A term that neither has, as if no term were in both.
    neither = (
        side(groups, "a", "held", "none", "kept").join(side(groups, "b", "held", "none"), "lang").where("source_a < source_b")
        .select("lang", "source_a", "source_b", F.when(F.col("kept_a") > 0, (
            F.col("kept_a") - F.col("held_a") - F.col("held_b")) * _differ("none_a", "none_b")).otherwise(0).alias("value")))
    once = neither.unionAll(alone).unionAll(both).groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(
        F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
        F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    return once.select("lang", "value", ends.alias("ends")).select("lang", "ends.*", "value")
