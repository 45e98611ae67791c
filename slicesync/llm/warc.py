"""WARC archives, written in deterministic shards and committed by a manifest.

Records are sorted by id and cut into shards at every ``shard_rows``-th id, counted over
the whole table, so the same table always gives the same files. A task writes its shards
one after another: each record is a gzip member of its own, headers and digests are made
anew from the payload, and a file is closed when its compressed size reaches the limit.
Files are written under temporary names, moved, and reported; the manifest, written last,
is the commit, and readers open only what it lists.

Records with equal payloads: the one with the smallest id (ties: any one of them) is the
response, the others are revisits that name it and carry no payload. Digests are compared,
not payloads, and aggregated before they are shuffled, so a payload that a third of all
records share is no more work than others.

Null payloads are empty payloads; null ids sort first and are written without an id. Rows
with the same id are records of their own. An empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slicesync.llm.batches import Files, qualified, slices
from slicesync.session import stage

FILE_BYTES = 64 << 20
SHARD_ROWS = 20_000
LEVEL = 5
MANIFEST = "shard int, part int, name string, n_records long, n_bytes long, sha1 string"
READ = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long")
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of a table have no capture time; a fixed one keeps the files the same.
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _identity(number: int | None, digest: str) -> str:
    return f"<urn:x-record:{'' if number is None else number}:{digest}>"


def record(number: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed; a revisit has the HTTP headers only."""
    digest = _base32(payload)
    block = HTTP if revisit else HTTP + payload
    head = [
        VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_identity(number, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_identity(refers_to, digest)}"]
    head += [
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_base32(block)}", f"WARC-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _packed(data: bytes) -> bytes:
    """A gzip member; its header has no time, so equal records give equal bytes."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Writer:
    def __init__(self, folder: str, file_bytes: int):
        self.files, self.file_bytes = Files(folder), file_bytes
        self.shard, self.part, self.sink, self.done = None, 0, None, []

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        if self.sink is None:
            self.temporary = self.files.begin()
            self.sink = self.files.store.open_output_stream(self.temporary, compression=None)
            self.records, self.size, self.sha1 = 0, 0, hashlib.sha1()
        data = _packed(data)
        self.sink.write(data)
        self.sha1.update(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        if self.size >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.sink is None:
            return
        self.sink.close()
        name = f"pages-{self.shard:06d}-{self.part:04d}.warc.gz"
        self.files.commit(self.temporary, name)
        self.done.append({
            "shard": self.shard, "part": self.part, "name": name, "n_records": self.records,
            "n_bytes": self.size, "sha1": self.sha1.hexdigest()})
        self.sink, self.part = None, self.part + 1


def shard_bounds(ids: DataFrame, shard_rows: int) -> list[int]:
    """Every ``shard_rows``-th id in order: exact ranks from counts of sorted partitions."""
    ordered = stage(
        ids.where("id IS NOT NULL").repartitionByRange("id").sortWithinPartitions("id")
        .select("id", F.spark_partition_id().alias("p")), "ids")
    counts = ordered.groupBy("p").agg(F.count("*").alias("n"))
    before = counts.select("p", F.coalesce(F.sum("n").over(
        Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1
    ranked = ordered.select("id", "p", own.alias("own")).join(before, "p")
    cut = ranked.where((F.col("before") + F.col("own")) % shard_rows == 0).select("id").distinct()
    return sorted(r[0] for r in cut.collect())


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    file_bytes: int = FILE_BYTES, shard_rows: int = SHARD_ROWS, revisit_bytes: int = 0,
) -> DataFrame:
    """Write all records below ``folder``; the manifest, as read from the store. Payloads of
    fewer than ``revisit_bytes`` bytes are always responses."""
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    kind = dict(pages.dtypes)[payload_col]
    payload = F.coalesce(F.col(payload_col).cast("binary" if kind == "binary" else "string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        payload.cast("binary").alias("payload"))
    digests = rows.where(F.length("payload") >= revisit_bytes).select("id", F.unhex(F.sha1("payload")).alias("sha"))
    first = digests.groupBy("sha").agg(
        F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = digests.join(first, "sha").select("id", "sha", "first").distinct()
    bounds = np.array(shard_bounds(rows.select("id"), shard_rows), np.int64)

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("id")
            at = np.searchsorted(bounds, number.fill_null(0).to_numpy(), side="right")
            at[number.is_null().to_numpy(zero_copy_only=False)] = 0
            yield batch.append_column("shard", pa.array(at.astype(np.int32)))

    # A row of ``repeated`` comes before the records of its id, in the same shard.
    both = repeated.select(
        "id", "sha", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload")
    ).unionAll(rows.select(
        "id", F.lit(None).cast("binary"), F.lit(None).cast("long"), "url", "payload"))
    dealt = both.mapInArrow(
        shard_of, "id long, sha binary, first long, url string, payload binary, shard int")
    tasks = max(1, len(bounds))
    order = ["shard", F.col("id").asc_nulls_first(), F.col("payload").isNotNull(), F.xxhash64("payload", "url")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, here, known, seen = _Writer(f"{folder}/data", file_bytes), None, {}, set()
        for batch in slices(batches, "payload"):
            for shard, number, sha, to, url, body in zip(*(
                batch.column(c).to_pylist() for c in ("shard", "id", "sha", "first", "url", "payload"))):
                if (shard, number) != here:
                    here, known, seen = (shard, number), {}, set()
                if body is None:
                    known[sha] = to
                    continue
                own = hashlib.sha1(body).digest()
                # The first record of the smallest id is the response.
                revisit = own in known and (known[own] != number or own in seen)
                seen.add(own)
                writer.add(shard, record(number, url, body, known.get(own), revisit))
        writer.close()
        if writer.done:
            yield pa.RecordBatch.from_pylist(writer.done, schema=_MANIFEST_ARROW)

    dealt.repartition(tasks, "shard").sortWithinPartitions(*order).mapInArrow(
        write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


_MANIFEST_ARROW = pa.schema([
    ("shard", pa.int32()), ("part", pa.int32()), ("name", pa.string()), ("n_records", pa.int64()),
    ("n_bytes", pa.int64()), ("sha1", pa.string())])


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, uncompressed, read in pieces."""
    unpacker, parts = zlib.decompressobj(31), []
    data = stream.read(1 << 20)
    while data:
        parts.append(unpacker.decompress(data))
        if unpacker.eof:
            yield b"".join(parts)
            data, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []
            if data:
                continue
        data = stream.read(1 << 20)


def parse(data: bytes) -> dict:
    """One record as a row of ``READ``; its digests and lengths must hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0]!r}")
    named = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(named["Content-Length"])]
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    if "sha1:" + _base32(block) != named["WARC-Block-Digest"]:
        raise ValueError(f"damaged block in {named['WARC-Record-ID']}")
    revisit = named["WARC-Type"] == "revisit"
    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
    if payload is not None and _base32(payload) != digest:
        raise ValueError(f"damaged payload in {named['WARC-Record-ID']}")
    number, refers = (
        (named[k].split(":")[2] or None) if k in named else None for k in ("WARC-Record-ID", "WARC-Refers-To"))
    return {
        "page_id": None if number is None else int(number), "url": named.get("WARC-Target-URI"),
        "payload": payload, "payload_bytes": int(named["WARC-Payload-Length"]), "payload_digest": digest,
        "record_type": named["WARC-Type"], "refers_to": None if refers is None else int(refers)}


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the committed archives, one file at a time in each task."""
    folder = qualified(spark, folder)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = None
        for batch in batches:
            for name in batch.column("name").to_pylist():
                files = files or Files(f"{folder}/data")
                held, size = [], 0
                with files.store.open_input_stream(f"{files.root}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        held.append(parse(member))
                        size += len(member)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    count = manifest.count()
    return manifest.select("name").repartition(max(1, min(count, 10_000)), "name").mapInArrow(read, READ)
