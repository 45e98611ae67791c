"""The audit of sources against SQL and brute force."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from compare import connect, differences
from slicesync.llm import divergence
from slicesync.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def audit(rows, least, top):
    """``rows``: (lang, source, text)."""
    rows = [(a or "", b or "", Counter(TERM.findall(lower(t)))) for a, b, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs, times, groups = Counter(), Counter(), defaultdict(Counter)
        for _, source, own in (r for r in rows if r[0] == lang):
            docs.update(own.keys())
            times.update(own)
            groups[source].update(own)
        kept = [t for t, n in docs.items() if n >= least]

        def share(counts):
            whole = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // whole for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        every, p = share(times), {s: share(c) for s, c in groups.items()}
        for s, own in groups.items():
            for part, values, most in (
                ("pair", [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s], None),
                ("term", [(t, f(p[s][t], every[t])) for t in kept if own[t] and p[s][t] > every[t]], top),
            ):
                values.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(values[:most])}
    return out


def test_against_sql(spark, sf_dir):
    name = "op13_source_divergence"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []


TEXTS = [
    None, "", "  ", "One, two; THREE-four", "don't one", "é1É ΑΣ日本 one", "one " * 50, "x\x00y\x7fz", "two\r\n\ttwo three",
    "1234 !!", "Two two,two", "ß_ß ſ K",
]


@pytest.mark.parametrize("least", [1, 2, 1000])
def test_against_brute_force(spark, least, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 60)  # many blocks and buckets
    monkeypatch.setattr(divergence, "BUCKET_BYTES", 40)
    monkeypatch.setattr(divergence, "FAN", 2)
    monkeypatch.setattr(divergence, "PAIRS", 5)
    rows = [("en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, t, i) for i, t in enumerate(TEXTS * 3)]
    rows += [("de", "only", None, 1), ("de", "other", "", 1), ("xx", "alone", "a b a", 1)]
    rows += [("en", "s1", "hot row that comes again", 7)] * 40  # repeated rows, a hot source
    docs = spark.createDataFrame(rows, "lang string, source string, text string, docs long")
    got = [tuple(r) for r in divergence.audit(docs, min_docs=least, top=3).collect()]
    assert len(got) == len(set(got))
    assert set(got) == audit([r[:3] for r in rows], least, 3)


def test_no_rows_and_one_source(spark):
    schema = "lang string, source string, text string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    alone = divergence.audit(spark.createDataFrame([("a", "b", "c c")], schema), min_docs=1)
    assert alone.count() == 0  # no other source, and no term above its language


def test_text_of_20_mb(spark):
    long = "alpha Beta, gamma-delta " * 900_000
    docs = spark.createDataFrame([("en", "s", long), ("en", "t", "alpha")], "lang string, source string, text string")
    rows = {(r.source, r.item): r.value for r in divergence.audit(docs, min_docs=1).collect() if r.part == "pair"}
    brute = {(a[1], a[3]): a[4] for a in audit([("en", "s", long), ("en", "t", "alpha")], 1, 10) if a[2] == "pair"}
    assert rows == brute


def test_chunks_do_not_depend_on_the_order_of_rows():
    """A block is read twice, each time with its rows in any order; answers go by place."""
    texts, seen = [t for t in TEXTS if t is not None] * 2, set()
    for seed in range(4):
        random.Random(seed).shuffle(texts)
        found = divergence._Chunks(pa.array(texts, pa.string()), 3)
        seen.add((tuple(found.words.take(pa.array(found.order)).to_pylist()), tuple(found.cuts.tolist())))
    assert len(seen) == 1
