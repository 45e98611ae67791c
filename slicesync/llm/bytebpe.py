"""Byte-level BPE ids by the ``tokenizers`` library, each distinct word encoded once.

A pre-token never goes on past a character that is not white space into white space, so
a text may be cut there and its parts encoded alone. Texts are cut at single spaces and
line ends; texts with two white-space characters in a row, or with a special token's
string, go to the library whole. The ids are the library's in every case.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from slicesync.llm.batches import gather, plain_text

# White space of Unicode, and the separators that some libraries count too.
_BLANK = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
    r"\x{3000}]"
)
#: Words whose ids a worker keeps, or those of one batch if they are more.
CACHE_WORDS = 1 << 20
#: Bytes of text to encode at once: the more, the fewer words are looked up again.
ENCODED_BYTES = 8 << 20
_JOINED = 64


class ByteBpe:
    """Encodes Arrow text arrays; ``end_id`` is appended to each text if given."""

    def __init__(self, path: str, end_id: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.end_id = end_id
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.width[number] = len(token)  # one character for each byte
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = "|".join([_BLANK + "{2}", *(pc_escape(s) for s in special)])
        self.known = pa.array([], pa.large_string())  # words as they stand between spaces
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)  # and their ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32).tobytes() for x in found]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with white space and end without, many in one call."""
        ids = np.array(
            self.library.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.uint32
        )
        ends = np.cumsum(self.width[ids])
        wanted = np.cumsum([len(w.encode()) for w in words])
        cuts = np.searchsorted(ends, wanted)
        if len(ends) == 0 or cuts[-1] >= len(ends) or (ends[cuts] != wanted).any():
            return self._whole(words)
        raw, stops = ids.tobytes(), [0, *(4 * cuts + 4).tolist()]
        return [raw[a:b] for a, b in zip(stops[:-1], stops[1:])]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words with what stands before them."""
        values: list[bytes] = [b""] * len(words)
        many, alone = [], []
        for at, word in enumerate(words):
            (many if word[:1] in (" ", "\n") and not word[-1:].isspace() else alone).append(at)
        for first in range(0, len(many), _JOINED):
            part = many[first : first + _JOINED]
            for at, value in zip(part, self._joined([words[i] for i in part])):
                values[at] = value
        for at, value in zip(alone, self._whole([words[i] for i in alone]) if alone else ()):
            values[at] = value
        return values

    def _known(self, words: pa.Array) -> np.ndarray:
        """The place of each word among the known ones; new words are encoded first."""
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(at.is_null())
        if len(new) + len(self.known) > CACHE_WORDS:  # keep those that are used now
            used = np.unique(at.drop_null().to_numpy())
            sizes = np.diff(self.starts)[used]
            self.ids = self.ids[gather(self.starts[used], sizes)]
            self.known, self.starts = self.known.take(pa.array(used)), np.append(0, np.cumsum(sizes))
            at = None
        if len(new):
            # One space stands before each, but for those that begin a line.
            values = self._words([w if w[:1] == "\n" else " " + w for w in new.to_pylist()])
            sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(values), np.uint32)])
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
            first = len(self.known)
            self.known = pa.concat_arrays([self.known, new])
            if at is not None:
                found = at.fill_null(0).to_numpy().astype(np.int64)
                found[at.is_null().to_numpy(zero_copy_only=False)] = np.arange(first, first + len(new))
                return found
        return (pc.index_in(words, value_set=self.known) if at is None else at).to_numpy().astype(np.int64)

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        flat = pieces.flatten()
        inner, firsts = flat.dictionary_encode(), flat.take(pa.array(bounds[:-1])).dictionary_encode()
        known = self._known(inner.dictionary)
        begun = self._words(firsts.dictionary.to_pylist())  # no space before the first
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(begun), np.uint32)])
        lengths = np.fromiter(map(len, begun), np.int64, len(begun)) // 4
        starts = np.append(self.starts[known], len(self.ids) + np.cumsum(lengths) - lengths)
        lengths = np.append((self.starts[1:] - self.starts[:-1])[known], lengths)
        codes = inner.indices.to_numpy().astype(np.int64)
        codes[bounds[:-1]] = firsts.indices.to_numpy() + len(known)
        sizes = lengths[codes]
        return ids[gather(starts[codes], sizes)], np.concatenate([[0], np.cumsum(sizes)])[bounds]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and the offsets of each text's ids; null is empty text."""
        texts = plain_text(column)
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        ids, offsets = self._regular(texts.filter(pa.array(~odd))) if not odd.all() else (
            np.zeros(0, np.uint32), np.zeros(1, np.int64))
        if not odd.any() and self.end_id is None:
            return ids, offsets
        parts, counts = [], np.zeros(len(texts), np.int64)
        regular, whole = 0, iter(self._whole(texts.filter(pa.array(odd)).to_pylist()))
        end = np.zeros(0, np.uint32) if self.end_id is None else np.array([self.end_id], np.uint32)
        for at, is_odd in enumerate(odd):
            if is_odd:
                own = np.frombuffer(next(whole), np.uint32)
            else:
                own = ids[offsets[regular] : offsets[regular + 1]]
                regular += 1
            counts[at] = len(own) + len(end)
            parts += [own, end]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])


def pc_escape(text: str) -> str:
    """The text as a pattern that matches it literally."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


@lru_cache(maxsize=2)
def byte_bpe(path: str, end_id: int | None = None) -> ByteBpe:
    """One encoder for each worker process, so that its cache outlives a task."""
    return ByteBpe(path, end_id)
