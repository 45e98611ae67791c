"""Documents to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicesync.llm.queries import END_ID, table, tokenizer_path
from slicesync.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the texts now are."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that are not prose, and without documents that fail.

    Null and empty texts fail; each row is judged by itself, repeated rows alike.
    """
    from slicesync.llm.quality import clean

    return _counted(clean(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8).

    The smallest id stays; rows equal in id and text are one. Null or empty texts, and rows
    without id, link with nothing and stay.
    """
    from slicesync.llm.minhash import one_of_each

    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of 35 words that stand anywhere else too.

    Null text becomes empty text. Repeated rows lose what they share, all of them; a document
    that loses all its words stays, with empty text.
    """
    from slicesync.llm.substrings import without_repeats

    return _counted(without_repeats(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' tokens in sequences of at most 1024.

    Null and empty texts are their end id alone; rows with the same id are packed each for itself.
    """
    from slicesync.llm.packing import pack, token_pieces

    return pack(token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), END_ID))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Near duplicates and tokenizer ids are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
