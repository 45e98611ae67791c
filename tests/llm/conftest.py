import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def byte_bpe():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_bpe():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


#: Nulls, empty and long texts, ties, repeated rows, odd white space, special tokens.
EDGE_TEXTS = [
    None, "", " ", "\n\n", "a", "a  b \n c\t\x0bd", "one two three four five six", "é😀 日本語 naïve ΑΣ ΣΑΣ",
    "x<|endoftext|>y <|startoftext|> z", "  lead and trail  ", "tab\tnbsp\u00a0 end\x1c \x85x", "it's they'LL 've ½²",
    "word " * 3000, "longword" * 700, "same text here twice", "same text here twice",
    "The quick brown fox jumps over the lazy dog. " * 12, "\r\n line\r\n\r\nline",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge cases under columns whose names clash with the operators' own."""
    rows = [(i, t, i, "k", float(i)) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(None, "no id but text", 1, "k", 0.0), (3, EDGE_TEXTS[3], 3, "k", 3.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, bin string, w double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_chars long, bin string, w double")
