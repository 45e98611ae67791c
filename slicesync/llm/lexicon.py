"""BPE with word ends: a memory-mapped lexicon of frequent words, exact merges for the rest.

Words are counted over all documents in bounded summaries: a task that holds more than
``SUMMARY`` words takes the smallest counts off all of them, so that every word with more
than one in ``SUMMARY`` of all occurrences is surely among those reported. The most
frequent are encoded and compiled into a minimal acyclic transducer: states with the same
continuations are one state, and the outputs along a word's arcs sum to its number, under
which its ids are stored. The transducer is one file in the shared folder, which tasks map
into memory. Words that it does not hold are merged exactly, pair by pair in rank order;
either way the ids are those of the tokenizer's file.

Null text is empty text, which has no ids and decodes to empty text. A very long word costs
n log n merges. Rows with the same id are encoded each for itself. No rows give no rows, and
a corpus without words gives a lexicon without words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicesync.llm.batches import Files, qualified, slices, words_of
from slicesync.session import run_dir, stage

LEXICON_WORDS = 50_000
SUMMARY = 100_000
#: Words with less than one in so many times ``LEXICON_WORDS`` of all occurrences are left out.
RARE = 10
CACHE_WORDS = 200_000
ENCODED_BYTES = 8 << 20
#: Words up to this long are merged by scanning, longer ones with a heap.
_SCANNED = 100


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, others after it."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordBpe:
    """The tokenizer of a file: normalisation, words, merges and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.end = model["end_of_word_suffix"]
        self.word = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.tokens = {number: token for token, number in [*vocabulary.items(), *self.special.items()]}
        alphabet = byte_alphabet()
        self.inner = [vocabulary[c] for c in alphabet]
        self.last = [vocabulary[c + self.end] for c in alphabet]
        self.rank = {(vocabulary[a], vocabulary[b]): n for n, (a, b) in enumerate(model["merges"])}
        self.merged = [vocabulary[a + b] for a, b in model["merges"]]

    def words(self, chunk: str) -> list[str]:
        """Words of a stretch of text between white space, without special tokens."""
        chunk = unicodedata.normalize("NFC", chunk)
        lowered = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
        return self.word.findall(lowered)

    def merge(self, word: str) -> list[int]:
        """Exact ids of one word."""
        raw = word.encode()
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        return self._scan(parts) if len(parts) <= _SCANNED else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        """The lowest rank first, leftmost first; only ranks beside a merge change."""
        rank, none = self.rank.get, len(self.merged)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at] = self.merged[best]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), none)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []

        def offer(at: int) -> None:
            to = after[at]
            if to < n and (found := self.rank.get((parts[at], parts[to]))) is not None:
                queue.append((found, at, parts[at], parts[to]))

        for at in range(n - 1):
            offer(at)
        heapq.heapify(queue)
        while queue:
            best, at, left, right = heapq.heappop(queue)
            to = after[at]
            if parts[at] != left or to >= n or parts[to] != right:
                continue
            parts[at], parts[to] = self.merged[best], -1
            after[at] = after[to]
            if after[to] < n:
                before[after[to]] = at
            for near in (before[at], at):
                if near >= 0 and after[near] < n and (
                    found := self.rank.get((parts[near], parts[after[near]]))) is not None:
                    heapq.heappush(queue, (found, near, parts[near], parts[after[near]]))
        return [p for p in parts if p >= 0]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, special tokens included; the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


class Transducer:
    """A minimal acyclic transducer from words to ids, in flat arrays."""

    NAMES = ("arc", "target", "output", "final", "offset", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arc, self.target, self.output, self.final, self.offset, self.ids = (
            arrays[n] for n in self.NAMES)

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Transducer:
        """Words in order are added to a trie whose finished branches are shared at once."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # final, words below, arcs of (byte, state)

        def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append((final, final + sum(states[s][1] for _, s in arcs), arcs))
            return register[key]

        open_states: list[list] = [[False, []]]  # along the last word: final, arcs
        last = b""

        def close(depth: int) -> None:
            while len(open_states) > depth + 1:
                final, arcs = open_states.pop()
                open_states[-1][1].append((last[len(open_states) - 1], freeze(final, arcs)))

        ordered = sorted(entries)
        for word in ordered:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            close(common)
            open_states += [[False, []] for _ in word[common:]]
            open_states[-1][0] = True
            last = word
        close(0)
        root = freeze(*open_states[0])
        # States are numbered from the root; an arc is found by its state and byte.
        number = {root: 0} | {s: i for i, s in enumerate((s for s in range(len(states)) if s != root), 1)}
        rows = []
        for s, (final, _, arcs) in enumerate(states):
            passed = int(final)
            for byte, to in arcs:
                rows.append((number[s] << 8 | byte, number[to], passed))
                passed += states[to][1]
        rows.sort()
        columns = np.array(rows, np.int64).reshape(-1, 3)
        final = np.zeros(len(states), np.uint8)
        for s, state in enumerate(states):
            final[number[s]] = state[0]
        lengths = [len(entries[w]) for w in ordered]
        return cls({
            "arc": columns[:, 0].copy(), "target": columns[:, 1].copy(), "output": columns[:, 2].copy(),
            "final": final, "offset": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
            "ids": np.array([i for w in ordered for i in entries[w]], np.uint32)})

    def find(self, words: list[str]) -> np.ndarray:
        """The number of each word, or -1: all words take a step at a time."""
        raw = [w.encode() for w in words]
        out = np.full(len(raw), -1, np.int64)
        if not len(self.arc) or not raw:
            return out
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        at = np.cumsum(lengths) - lengths
        live = np.flatnonzero(lengths > 0)
        state, number, step = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            wanted = state << 8 | data[at[live] + step]
            place = np.minimum(np.searchsorted(self.arc, wanted), len(self.arc) - 1)
            good = self.arc[place] == wanted
            live, place, number = live[good], place[good], number[good]
            state, number, step = self.target[place], number + self.output[place], step + 1
            ended = lengths[live] == step
            whole = ended & (self.final[state] == 1)
            out[live[whole]] = number[whole]
            live, state, number = live[~ended], state[~ended], number[~ended]
        return out

    def ids_of(self, number: int) -> bytes:
        return self.ids[self.offset[number] : self.offset[number + 1]].tobytes()

    def save(self, folder: str, name: str) -> str:
        """Write under a temporary name and move; one row with a list for each array."""
        files = Files(folder)
        lists = [pa.array([getattr(self, n)]) for n in self.NAMES]
        batch = pa.RecordBatch.from_arrays(lists, list(self.NAMES))
        temporary = files.begin()
        with files.store.open_output_stream(temporary, compression=None) as sink:
            with pa.ipc.new_file(sink, batch.schema) as out:
                out.write_batch(batch)
        files.commit(temporary, name)
        return f"{folder}/{name}"

    @classmethod
    def load(cls, uri: str) -> Transducer:
        """Mapped into memory where the store is a file system, else read once."""
        store, path = fs.FileSystem.from_uri(uri)
        local = isinstance(store, fs.LocalFileSystem)
        source = pa.memory_map(path) if local else pa.BufferReader(store.open_input_file(path).read_buffer())
        batch = pa.ipc.open_file(source).get_batch(0)
        return cls({n: batch.column(n).flatten().to_numpy() for n in cls.NAMES})


class Encoder:
    """Texts to ids by the lexicon, with exact merges for words that it does not hold."""

    def __init__(self, path: str, lexicon: Transducer):
        self.bpe, self.lexicon = WordBpe(path), lexicon
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _new(self, chunks: list[str]) -> list[bytes]:
        split, wanted = [], {}
        for chunk in chunks:
            parts: list = []
            for piece in self.bpe.specials.split(chunk) if "<|" in chunk else (chunk,):
                if piece in self.bpe.special:
                    parts.append(np.uint32(self.bpe.special[piece]).tobytes())
                else:
                    for word in self.bpe.words(piece):
                        parts.append(word)
                        wanted[word] = None
            split.append(parts)
        words = list(wanted)
        for word, number in zip(words, self.lexicon.find(words).tolist()):
            wanted[word] = self.lexicon.ids_of(number) if number >= 0 else np.array(
                self.bpe.merge(word), np.uint32).tobytes()
        return [b"".join(p if isinstance(p, bytes) else wanted[p] for p in parts) for parts in split]

    def _lookup(self, chunks: list[str]) -> list[bytes]:
        values = [self.young.get(c) or self.old.get(c) for c in chunks]
        missing = [at for at, value in enumerate(values) if value is None]
        for at, value in zip(missing, self._new([chunks[i] for i in missing])):
            values[at] = value
        self.young.update(zip(chunks, values))
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        return values

    def encode(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """All ids as little-endian 32-bit numbers, and the offsets of each text's ids."""
        codes, offsets, chunks = words_of(texts)
        values = self._lookup(chunks.to_pylist())
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids = b"".join(map(values.__getitem__, codes.tolist()))
        return ids, np.concatenate([[0], np.cumsum(lengths[codes])])[offsets]


@lru_cache(maxsize=2)
def encoder(path: str, lexicon_uri: str) -> Encoder:
    return Encoder(path, Transducer.load(lexicon_uri))


def frequent_words(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS, text_col: str = "text") -> list[str]:
    """The most frequent words over all documents, ``most`` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for part in slices(batches, "text", ENCODED_BYTES):
            codes, _, chunks = words_of(part.column("text"))
            for chunk, n in zip(chunks.to_pylist(), np.bincount(codes, minlength=len(chunks)).tolist()):
                held[chunk] = held.get(chunk, 0) + n
            if len(held) > SUMMARY:
                off = int(np.partition(np.fromiter(held.values(), np.int64), -SUMMARY)[-SUMMARY])
                held = {c: n - off for c, n in held.items() if n > off}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["chunk", "n"])

    counted = stage(
        docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "chunk string, n long")
        .groupBy("chunk").agg(F.sum("n").alias("n")), "words")
    # At most ``RARE * most`` words have such a share, so the sort stays small at every size.
    share = counted.agg(F.coalesce(F.sum("n"), F.lit(0)) / (RARE * most)).first()[0]
    top = counted.where(F.col("n") >= share).orderBy(F.desc("n"), "chunk").limit(most)
    bpe, counts = WordBpe(tokenizer), {}
    for chunk, n in top.collect():  # at most ``most`` rows
        for word in bpe.words(chunk):
            counts[word] = counts.get(word, 0) + n
    return sorted(counts, key=lambda w: (-counts[w], w))[:most]


def compile_lexicon(spark: SparkSession, words: list[str], tokenizer: str, folder: str) -> str:
    """Encode the words, build the transducer and write it; its place."""
    bpe = WordBpe(tokenizer)
    return Transducer.build({w.encode(): bpe.merge(w) for w in words}).save(
        qualified(spark, folder), "lexicon.arrow")


def encode_and_decode(
    docs: DataFrame, tokenizer: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, and with ``with_ids`` the ids and
    the decoded text themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, lexicon)
        for part in slices(batches, "text", ENCODED_BYTES):
            raw, offsets = own.encode(part.column("text"))
            ids = np.frombuffer(raw, "<u4")
            hashes, decoded, texts = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                text = own.bpe.decode(ids[a:b].tolist())
                hashes.append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    texts.append(text)
            columns = [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(hashes, pa.string()),
                       pa.array(decoded, pa.string())]
            if with_ids:
                columns += [pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(chosen.dtypes)["doc_id"]
    more = ", ids array<int>, decoded string" if with_ids else ""
    return chosen.mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def lexicon_for(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS) -> str:
    """The lexicon of a corpus, in the shared folder."""
    spark = docs.sparkSession
    return compile_lexicon(spark, frequent_words(docs, tokenizer, most), tokenizer, run_dir(spark, "lexicon"))
