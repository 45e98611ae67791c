"""URL filter: host and path rules first, then a weighted vocabulary.

One Aho-Corasick automaton finds all terms of the vocabulary in a single pass over the
URL. A hit counts only where it is a word of its own (no letter or digit on either side).
One strict term, or several distinct soft ones, blocks the URL.

Null URLs and URLs without ``://`` have an empty host and path; no rule fits an empty host,
and the vocabulary still judges the URL's text (null: empty, allowed). Rows with the same
id are judged each for itself. No rows give no rows. Work is row by row, so neither a
frequent host nor a long URL makes a task wait for others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabulary. Strict terms block alone, soft ones only together.
STRICT = ("adult", "casino", "escort", "hentai", "porn", "porno", "spam", "viagra", "xxx")
SOFT = (
    "ad", "ads", "bet", "bets", "bonus", "buy", "cheap", "cialis", "click", "credit", "crypto", "deal",
    "deals", "farm", "free", "jackpot", "loan", "loans", "lottery", "pill", "pills", "poker", "prize",
    "promo", "sale", "sex", "slots", "track", "tracker", "win", "winner",
)
SOFT_HITS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``host`` and all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


@lru_cache(maxsize=4)
def vocabulary(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for weight, terms in ((False, soft), (True, strict)):
        for term in terms:
            automaton.add_word(term, (term, weight))
    automaton.make_automaton()
    return automaton


def hits(text: str, automaton) -> tuple[int, int]:
    """Distinct strict and distinct soft terms that are words of their own in ``text``."""
    strict, soft = set(), set()
    if len(automaton):
        for end, (term, is_strict) in automaton.iter(text):
            before, after = end - len(term), end + 1
            if (before < 0 or not text[before].isalnum()) and (
                after == len(text) or not text[after].isalnum()
            ):
                (strict if is_strict else soft).add(term)
    return len(strict), len(soft)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule) -> Column:
    host, path = F.col("host"), F.col("path")
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def filter_urls(
    pages: DataFrame, rules: Iterable[Rule] = (), id_col: str = "page_id", url_col: str = "url",
    strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, n_strict, n_soft)`` for each row."""
    strict, soft = tuple(strict), tuple(soft)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = vocabulary(strict, soft)
        for batch in batches:
            found = [hits(text, automaton) for text in batch.column("text").to_pylist()]
            columns = [batch.column(n) for n in ("page_id", "host", "path", "rule", "ruled")]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(pa.array([f[i] for f in found], pa.int32()) for i in (0, 1))],
                ["page_id", "host", "path", "rule", "ruled", "n_strict", "n_soft"])

    url = F.col(url_col).cast("string")
    parts = pages.select(
        F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
        F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER).alias("text"))
    # The longest rule that fits is the first that fits in this order.
    rule = verdict = F.lit(None).cast("string")
    for one in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        rule = F.when(_fits(one), one.host + one.path).otherwise(rule)
        verdict = F.when(_fits(one), one.verdict).otherwise(verdict)
    kind = dict(pages.select(F.col(id_col).alias("page_id")).dtypes)["page_id"]
    counted = parts.withColumn("rule", rule).withColumn("ruled", verdict).mapInArrow(
        count, f"page_id {kind}, host string, path string, rule string, ruled string, n_strict int, n_soft int")
    blocked = (F.col("n_strict") > 0) | (F.col("n_soft") >= soft_hits)
    return counted.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        "n_strict", "n_soft")
