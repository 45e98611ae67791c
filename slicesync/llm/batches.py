"""Arrow batches of bounded size, words as codes, and files in the shared folder."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession

#: Bytes of text that a task turns into arrays at once.
SLICE_BYTES = 4 << 20


def plain_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one large-string array, null as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(
    batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(sizes, dtype=np.int64), 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(first, last - first)
            first = last


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+``: codes, offsets of each text's codes, distinct words.

    White space and A-Z are single bytes in UTF-8, so they are changed in the buffer itself.
    """
    texts = plain_text(texts)
    if len(texts) == 0:
        return np.zeros(0, np.int32), np.zeros(1, np.int64), pa.array([], pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].copy() if data else np.zeros(0, np.uint8)
    raw[(raw >= 9) & (raw <= 13)] = 32
    if lower:
        raw[(raw >= 65) & (raw <= 90)] |= 32
    spaced = pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer((ends - ends[0]).copy()), pa.py_buffer(raw)
    )
    pieces = pc.split_pattern(spaced, " ")
    del raw, spaced, data, texts  # each is as large as the texts
    flat = pieces.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    bounds = pieces.offsets.to_numpy()
    offsets = np.concatenate([[0], np.cumsum(real, dtype=np.int64)])[bounds - bounds[0]]
    flat = flat.filter(pa.array(real))
    del pieces, bounds
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), offsets, coded.dictionary


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i]`` of all runs, one after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, so that Spark and tasks mean the same store."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(hadoop).toString()


class Files:
    """Files of one folder in a shared store, each visible only when complete."""

    def __init__(self, folder: str):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root, recursive=True)

    def begin(self) -> str:
        """A temporary name that no other attempt uses; readers skip names with ``_``."""
        return posixpath.join(self.root, f"_temporary-{uuid.uuid4().hex}")

    def commit(self, temporary: str, name: str) -> str:
        final = posixpath.join(self.root, name)
        self.store.move(temporary, final)
        return final
