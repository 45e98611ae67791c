"""One text of 20 MB beside short ones, in each operator on texts."""

import hashlib
import zlib

import numpy as np
import pytest
from slicesync.llm import divergence, htmltext, merkle, minhash, quality, substrings, suffixes
from slicesync.llm.packing import pack, token_pieces
from slicesync.llm.tokenfiles import read_checksums, write_token_files


@pytest.fixture(scope="module")
def long_docs(spark):
    """All words of the long text differ, but for a passage that it shares with the second."""
    numbers = np.random.default_rng(4).permutation(2_200_000)
    passage = " ".join(f"shared{i}" for i in range(60))
    long = " ".join([*(f"w{i:07d}" for i in numbers[:1_100_000]), passage, *(f"w{i:07d}" for i in numbers[1_100_000:])])
    rows = [(1, long, "en", "s", 1), (2, f"{passage} and an end", "en", "t", 1), (3, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), long, passage


def test_dedup_of_a_long_text(long_docs):
    docs, long, passage = long_docs
    assert len(long) > 19_000_000
    words = {r.row.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert (words[1].n_removed, words[2].n_removed) == (60, 60) and len(words[1].text) == len(long) - len(passage) - 1
    found = {r.row.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    # The space after the passage is in both too.
    assert found[1].n_removed == found[2].n_removed == len(passage) + 1 and found[1].n_spans == 1
    assert bytes(found[1].kept) == long.replace(passage + " ", "").encode()
    sizes = {r.doc_id: (r.n_shingles, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert sizes[1] == (2_200_060 - 4, True) and sizes[3] == (0, True)


def test_tokens_of_a_long_text(spark, long_docs, byte_bpe, folder):
    docs, *_ = long_docs
    write_token_files(docs, folder, byte_bpe, 2)
    whole = {r.doc_id: r.n_tokens for r in read_checksums(spark, folder).collect()}
    packed = pack(token_pieces(docs, byte_bpe, 2)).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == whole and whole[1] > 5_000_000 and whole[3] == 1


def test_rules_and_leaves_of_a_long_text(long_docs):
    docs, long, _ = long_docs
    judged = {r.doc_id: (r.n_words, r.kept) for r in quality.judge(docs).collect()}
    assert judged[1] == (2_200_060, True) and not judged[3][1]
    leaves = {r.doc_id: r.leaf for r in merkle.manifest(docs).collect()}
    assert leaves[1] == hashlib.sha256(f"1:11:s2:en1:1{len(long)}:{long}".encode()).hexdigest()
    pairs = divergence.audit(docs, min_docs=1).where("part = 'pair'").collect()
    assert {(r.source, r.item) for r in pairs} == {("s", "t"), ("t", "s")}


def test_page_of_20_mb():
    text = " ".join(f"w{i}" for i in range(2_600_000))
    page = f"<body><nav><a href=x>menu</a></nav><article><p>{text}</p></article><footer>f</footer></body>"
    assert zlib.crc32(htmltext.main_text(page).encode()) == zlib.crc32(text.encode())
