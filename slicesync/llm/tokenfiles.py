"""Token ids in Parquet list columns: delta-encoded, in row groups, with page indexes.

Documents are range-sorted by id; each task writes files under temporary names, moves
them to their final names and reports them. The manifest, written last, is the commit:
readers see only the files it lists, so a lost task leaves nothing behind but an unread
temporary file. Rows of a file carry where their ids start in the file, so a reader that
wants a few documents, or no ids at all, reads only those pages.

Null text is empty text (only the end id). Null ids of documents come first. Rows with
the same id keep the order of the input, and many of them are dealt over several files. An
empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slicesync.llm.batches import Files, qualified, slices
from slicesync.llm.bytebpe import ENCODED_BYTES, byte_bpe

FILE_TOKENS = 32 << 20
GROUP_TOKENS = 2 << 20
SHARD_BYTES = 24 << 20
ROWS = pa.schema([
    ("doc_id", pa.int64()), ("shard", pa.int32()), ("part", pa.int32()), ("start_in_file", pa.int64()),
    ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32())),
])
MANIFEST = "shard int, part int, name string, n_docs long, n_tokens long, first_id long, last_id long"


class _Writer:
    """Rolls files by tokens; ``done`` holds the manifest's row of each finished file."""

    def __init__(self, folder: str, shard: int, file_tokens: int, group_tokens: int):
        self.files, self.shard, self.part = Files(folder), shard, 0
        self.file_tokens, self.group_tokens = file_tokens, group_tokens
        self.out, self.held, self.held_tokens = None, [], 0
        self.done: list[dict] = []

    def _open(self) -> None:
        self.temporary = self.files.begin()
        self.sink = self.files.store.open_output_stream(self.temporary)
        self.out = pq.ParquetWriter(
            self.sink, ROWS, compression="zstd", use_dictionary=False, write_page_index=True,
            data_page_size=256 << 10, version="2.6",
            column_encoding={n: "DELTA_BINARY_PACKED" for n in (
                "doc_id", "shard", "part", "start_in_file", "n_tokens", "ids.list.element")},
        )
        self.docs, self.tokens, self.first, self.last = 0, 0, None, None

    def add(self, doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        """Documents in order; a row group and a file end with the document that fills them."""
        first = 0
        while first < len(doc_ids):
            if self.out is None:
                self._open()
            room = min(self.file_tokens - self.tokens, self.group_tokens - self.held_tokens)
            last = min(int(np.searchsorted(offsets, offsets[first] + room)), len(doc_ids))
            last = max(last, first + 1)
            self._hold(doc_ids.slice(first, last - first), ids[offsets[first] : offsets[last]],
                       offsets[first : last + 1] - offsets[first])
            first = last
            if self.held_tokens >= self.group_tokens:
                self._flush()
            if self.tokens >= self.file_tokens:
                self.close()

    def _hold(self, doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        counts, n = np.diff(offsets), len(doc_ids)
        table = pa.Table.from_arrays([
            doc_ids.cast(pa.int64()), pa.array(np.full(n, self.shard, np.int32)),
            pa.array(np.full(n, self.part, np.int32)), pa.array(self.tokens + offsets[:-1]),
            pa.array(counts.astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))),
        ], schema=ROWS)
        known = [x for x in (doc_ids[0].as_py(), doc_ids[-1].as_py()) if x is not None]
        self.first = self.first if self.first is not None else (known[0] if known else None)
        self.last = known[-1] if known else self.last
        self.docs, self.tokens = self.docs + n, self.tokens + int(offsets[-1])
        self.held, self.held_tokens = [*self.held, table], self.held_tokens + int(offsets[-1])

    def _flush(self) -> None:
        if self.held:
            whole = pa.concat_tables(self.held)
            self.out.write_table(whole, row_group_size=max(1, whole.num_rows))
        self.held, self.held_tokens = [], 0

    def close(self) -> None:
        if self.out is None:
            return
        self._flush()
        self.out.close()
        self.sink.close()
        name = f"tokens-{self.shard:05d}-{self.part:05d}.parquet"
        self.files.commit(self.temporary, name)
        self.done.append({
            "shard": self.shard, "part": self.part, "name": name, "n_docs": self.docs,
            "n_tokens": self.tokens, "first_id": self.first, "last_id": self.last,
        })
        self.out, self.part = None, self.part + 1


def shards_for(docs: DataFrame, text_col: str, shard_bytes: int = SHARD_BYTES) -> int:
    """Tasks of about ``shard_bytes`` of text each, by the whole table's size."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return int(total // shard_bytes) + 1


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", file_tokens: int = FILE_TOKENS, group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Encode all texts into files of ``folder``; the manifest, as read from the store."""
    spark = docs.sparkSession
    folder = qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer, end_id)
        writer = _Writer(
            f"{folder}/data", TaskContext.get().partitionId(), file_tokens, group_tokens)
        for part in slices(batches, "text", ENCODED_BYTES):
            writer.add(part.column("doc_id"), *encoder.encode(part.column("text")))
        writer.close()
        if writer.done:
            yield pa.RecordBatch.from_pylist(writer.done, schema=_MANIFEST_ARROW)

    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The place in the input splits rows of one id; ranges are found without reading a text.
    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
    placed = chosen.withColumn("place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(shards_for(chosen, "text"), *order).sortWithinPartitions(*order)
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


_MANIFEST_ARROW = pa.schema([
    ("shard", pa.int32()), ("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()),
    ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()),
])


def file_starts(manifest: DataFrame) -> DataFrame:
    """Tokens before each file. One row for each file, so the window stays small."""
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select(
        "shard", "part", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("file_start"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows ``(doc_id, start, n_tokens, ids)`` of the committed files; filters reach the pages.
    Only the files that the manifest lists are opened; their names are all the driver gets."""
    folder = qualified(spark, folder)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    schema = "doc_id long, shard int, part int, start_in_file long, n_tokens int, ids array<int>"
    names = [f"{folder}/data/{r.name}" for r in manifest.select("name").collect()]
    rows = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    return rows.join(file_starts(manifest), ["shard", "part"]).select(
        "doc_id", (F.col("file_start") + F.col("start_in_file")).alias("start"),
        F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of the committed files, a row group at a time:
    each task opens files that the manifest lists and sends no ids on."""
    folder = qualified(spark, folder)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    files = manifest.select("shard", "part", "name").join(file_starts(manifest), ["shard", "part"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = None
        for batch in batches:
            for name, start in zip(*(batch.column(c).to_pylist() for c in ("name", "file_start"))):
                store = store or Files(f"{folder}/data")
                with store.store.open_input_file(f"{store.root}/{name}") as source:
                    file = pq.ParquetFile(source)
                    for number in range(file.num_row_groups):
                        rows = file.read_row_group(number, ["doc_id", "start_in_file", "ids"]).combine_chunks()
                        for part in rows.to_batches():
                            yield _checksums(part, start)

    count = max(1, min(manifest.count(), 10_000))
    return files.repartition(count, "name").select("name", "file_start").mapInArrow(read, CHECKSUMS)


CHECKSUMS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _checksums(part: pa.RecordBatch, start: int) -> pa.RecordBatch:
    ids = part.column("ids")
    bounds, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
    sums = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(part.column("start_in_file").to_numpy() + start),
         pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())],
        ["doc_id", "start", "n_tokens", "ids_crc32"])
