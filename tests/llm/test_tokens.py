"""Packing, token files and the lexicon against the tokenizers library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from slicesync.llm import lexicon as lx
from slicesync.llm.bytebpe import ByteBpe
from slicesync.llm.packing import best_fit, pack, token_pieces
from slicesync.llm.queries import QUERIES
from slicesync.llm.tokenfiles import read_checksums, read_token_files, write_token_files

END = 2


def library(path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


def ids_of(docs, path):
    own = library(path)
    return [(r.doc_id, np.array(own.encode(r.text or "", add_special_tokens=False).ids + [END], "<u4"))
            for r in docs.select("doc_id", "text").collect()]


def check_packing(rows, expected, capacity=1024):
    texts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        texts[r.doc_id].append(r)
    for members in sequences.values():
        place = 0
        for offset, length in sorted(members):
            assert offset == place
            place += length
        assert place <= capacity
    for number, ids in expected:
        place = 0
        for k, r in enumerate(sorted(texts[number], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, place)
            assert r.ids_crc32 == zlib.crc32(ids[place : place + r.length].tobytes())
            assert k == 0 or r.length == capacity
            place += r.length
        assert place == len(ids)
    return len(sequences), -(-sum(len(i) for _, i in expected) // capacity)


def test_packing_of_the_table(spark, sf_dir, byte_bpe):
    rows = QUERIES["op1_best_fit_packing"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    used, least = check_packing(rows, ids_of(docs, byte_bpe))
    assert used <= 1.02 * least + 1


def test_packing_of_edge_cases(edge_docs, no_docs, byte_bpe):
    distinct = edge_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = pack(token_pieces(distinct, byte_bpe, END)).collect()
    check_packing(rows, ids_of(distinct, byte_bpe))
    repeated = pack(token_pieces(edge_docs, byte_bpe, END))
    assert repeated.selectExpr("sum(length)").first()[0] == sum(len(i) for _, i in ids_of(edge_docs, byte_bpe))
    assert pack(token_pieces(no_docs, byte_bpe, END)).count() == 0


@pytest.mark.parametrize("tasks", [1, 7])
def test_rounds_merge_what_tasks_leave(spark, tasks):
    """Each long item has a short one that fills its bin, perhaps in another task."""
    pieces = spark.range(4000, numPartitions=tasks).selectExpr(
        "id AS doc_id", "0 AS piece", "0L AS start", "CASE WHEN id < 2000 THEN 624L ELSE 400L END AS length",
        "id AS ids_crc32")
    rows = pack(pieces).collect()
    assert len(rows) == 4000 and len({r.sequence_id for r in rows}) == 2000


def test_best_fit_takes_the_fullest_bin_that_fits():
    assert best_fit(np.array([6, 5, 4, 3, 2]), 10) == [[0, 2], [1, 3, 4]]


def test_byte_bpe_is_the_library(byte_bpe):
    from conftest import EDGE_TEXTS

    texts = [t or "" for t in EDGE_TEXTS] + ["a\tb c\nd", "x\n", "\nx", " \nx", "end ", "日本 語"]
    own, all_ids = ByteBpe(byte_bpe), [library(byte_bpe).encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # from the library, then from the cache
        ids, offsets = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == all_ids


def test_token_files_of_the_table(spark, sf_dir, byte_bpe):
    rows = {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_token_files"](spark, sf_dir).collect()}
    start = 0
    for number, ids in sorted(ids_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_bpe)):
        assert rows.pop(number) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not rows


def test_token_files_roll_and_are_read_selectively(spark, edge_docs, no_docs, byte_bpe, folder):
    manifest = write_token_files(edge_docs, folder, byte_bpe, END, file_tokens=2000, group_tokens=500)
    assert manifest.count() >= 2
    back = read_token_files(spark, folder)
    expected = ids_of(edge_docs, byte_bpe)
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in back.collect()) == sorted(
        (i or -1, tuple(ids.tolist())) for i, ids in expected)
    starts = sorted((r.start, r.n_tokens) for r in back.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    some = back.where("doc_id = 6")
    assert [r.ids for r in some.collect()] == [ids.tolist() for i, ids in expected if i == 6]
    assert "EqualTo(doc_id,6)" in some._jdf.queryExecution().toString()
    write_token_files(no_docs, f"{folder}-none", byte_bpe, END)
    assert read_token_files(spark, f"{folder}-none").count() == 0
    assert read_checksums(spark, f"{folder}-none").count() == 0


def test_only_listed_token_files_are_read(spark, edge_docs, byte_bpe, tmp_path):
    """A file of another attempt, with the same shard and part, is not in the manifest."""
    folder = tmp_path / "t"
    write_token_files(edge_docs, str(folder), byte_bpe, END, file_tokens=2000)
    one = next((folder / "data").glob("tokens-*.parquet"))
    one.with_name("tokens-of-a-lost-attempt.parquet").write_bytes(one.read_bytes())
    one.with_name("tokens-99999-00000.parquet").write_bytes(b"not a file of rows")
    expected = ids_of(edge_docs, byte_bpe)
    assert read_token_files(spark, str(folder)).count() == len(expected)
    sums = read_checksums(spark, str(folder)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in sums) == sorted(
        (i or -1, len(ids), zlib.crc32(ids.tobytes())) for i, ids in expected)
    starts = sorted((r.start, r.n_tokens) for r in sums)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_token_files_are_delta_encoded_with_page_indexes(spark, sf_dir, byte_bpe, tmp_path):
    import pyarrow.parquet as pq

    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path / "t"), byte_bpe, END)
    path = next((tmp_path / "t" / "data").glob("tokens-*.parquet"))
    meta = pq.ParquetFile(path).metadata
    column = meta.row_group(0).column(meta.num_columns - 1)
    assert "DELTA_BINARY_PACKED" in column.encodings and column.has_offset_index and column.has_column_index


def test_lexicon_query_is_the_library(spark, sf_dir, word_bpe):
    own = library(word_bpe)
    rows = {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_bpe_lexicon"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        text = own.decode(ids, skip_special_tokens=False)
        assert rows[r.doc_id] == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest())


def test_lexicon_edge_cases(edge_docs, no_docs, word_bpe):
    own, place = library(word_bpe), lx.lexicon_for(edge_docs, word_bpe, 5)
    rows = lx.encode_and_decode(edge_docs, word_bpe, place, with_ids=True).collect()
    expected = [own.encode(r.text or "", add_special_tokens=False).ids for r in edge_docs.collect()]
    assert sorted(r.ids for r in rows) == sorted(expected)
    assert sorted(r.decoded for r in rows) == sorted(own.decode(i, skip_special_tokens=False) for i in expected)
    assert lx.encode_and_decode(no_docs, word_bpe, lx.lexicon_for(no_docs, word_bpe)).count() == 0


def test_transducer_is_minimal_and_exact(word_bpe):
    bpe = lx.WordBpe(word_bpe)
    words = ["walking", "talking", "walked", "talked", "walk", "talk", "日本"]
    own = lx.Transducer.build({w.encode(): bpe.merge(w) for w in words})
    assert len(own.final) < 25  # "alk", "ing" and "ed" are shared
    found = own.find([*words, "wal", "walks", "", "x"])
    assert sorted(found[: len(words)]) == list(range(len(words))) and (found[len(words) :] == -1).all()
    for word, number in zip(words, found):
        assert np.frombuffer(own.ids_of(number), np.uint32).tolist() == bpe.merge(word)


def test_long_words_merge_as_short_ones_do(word_bpe):
    bpe = lx.WordBpe(word_bpe)
    for word in ("thethethe" * 20, "a" * 999, "éß" * 50):
        raw = word.encode()
        parts = [bpe.inner[b] for b in raw]
        parts[-1] = bpe.last[raw[-1]]
        assert bpe._heap(list(parts)) == bpe._scan(list(parts)) == library(word_bpe).encode(word).ids


def test_summaries_keep_frequent_words(spark, word_bpe, monkeypatch):
    docs = spark.createDataFrame([(i, f"common w{i} often often v{i}") for i in range(500)], "doc_id long, text string")
    assert set(lx.frequent_words(docs, word_bpe, 3)) >= {"common", "often"}
