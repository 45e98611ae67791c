"""Suffix arrays, and substring removal by them, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from slicesync.llm import lyndon, suffixes
from slicesync.llm.lyndon import LyndonGroups, suffix_array
from slicesync.llm.queries import QUERIES


def flat(texts):
    symbols = [0]
    for text in texts:
        symbols += [x + 1 for x in text] + [0]
    return symbols


def suffix(symbols, at):
    end = at
    while symbols[end]:
        end += 1
    return symbols[at:end]


def in_order(texts):
    symbols = flat(texts)
    found = suffix_array(np.array(symbols)).tolist()
    assert sorted(found) == list(range(len(symbols)))
    each = [suffix(symbols, i) for i in found]
    return each == sorted(each)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=4))
def test_suffixes_are_in_order(texts):
    assert in_order(texts)


@pytest.mark.parametrize("rounds", [0, 64])
def test_suffixes_of_periodic_texts(rounds, monkeypatch):
    monkeypatch.setattr(lyndon, "ROUNDS", rounds)
    source = random.Random(3)
    for _ in range(60):
        word = [source.randrange(3) for _ in range(source.randrange(1, 6))]
        assert in_order([word * source.randrange(1, 30) + [source.randrange(4)] for _ in range(3)])
    assert in_order([list(b"line of text\n" * 40 + b"zz"), list(b" " + b"a" * 300), list(range(255, -1, -1))])


def test_groups_are_lyndon_prefixes():
    source = random.Random(5)
    for _ in range(200):
        symbols = flat([[source.randrange(3) for _ in range(source.randrange(1, 15))]])
        found, n = LyndonGroups(np.array(symbols)), len(symbols) - 1
        for i in range(1, n):
            smaller = [j for j in range(i + 1, n + 1) if symbols[j:n] < symbols[i:n]]
            assert found.after[i] == smaller[0]
            lower = [j for j in range(1, i) if symbols[j:n] < symbols[i:n]]
            assert found.before[i] == (lower[-1] if lower else 0)
        prefixes = [tuple(symbols[i : found.after[i]]) for i in range(1, n)]
        assert found.name[1:n].tolist() == [2 + sum(p < q for p in prefixes) for q in prefixes]


def removed(texts, width):
    """``(n_bytes, n_removed, spans, kept)`` of each text, by counting all windows."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + width] for t in raw for i in range(len(t) - width + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i + 1 : i + 1 + width] = True
        steps = np.diff(gone.astype(int))
        spans = list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist()))
        inner = gone[1:-1]
        out.append((len(t), int(inner.sum()), spans, np.frombuffer(t, np.uint8)[~inner].tobytes()))
    return out


def outcome(rows):
    return sorted((r.row.doc_id if r.row.doc_id is not None else -1, r.n_bytes, r.n_removed,
                   [(s.start, s.stop) for s in r.removed], bytes(r.kept)) for r in rows)


def test_removal_from_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_suffix_array_dedup"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for r, (n, gone, spans, kept) in zip(docs, removed([r.text for r in docs], 200)):
        assert rows[r.doc_id] == (n, gone, len(spans), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("width", [1, 2, 7, 40])
def test_removal_from_edge_cases(edge_docs, no_docs, width, monkeypatch):
    for name, value in (("BLOCK_BYTES", 900), ("BUCKET_VALUES", 300), ("SLICE", 700), ("PART", 150)):
        monkeypatch.setattr(suffixes, name, value)  # many blocks, buckets, slices and parts
    docs = edge_docs.collect()
    expected = removed([r.text for r in docs], width)
    got = suffixes.remove_repeats(edge_docs, width=width).collect()
    assert outcome(got) == sorted((-1 if r.doc_id is None else r.doc_id, *e) for r, e in zip(docs, expected))
    assert all(r.n_spans == len(r.removed) for r in got)
    assert suffixes.remove_repeats(no_docs).count() == 0
    assert suffixes.without_repeats(edge_docs, width=width).columns == edge_docs.columns


def test_removal_from_edited_copies(spark, monkeypatch):
    """A third of all texts are edited copies; others share a passage that goes on differently."""
    for name, value in (("BLOCK_BYTES", 6000), ("SLICE", 2500), ("PART", 1500)):
        monkeypatch.setattr(suffixes, name, value)
    source = random.Random(9)

    def noise(n):
        return "".join(source.choice("abcdefgh \n") for _ in range(n))

    base, passage, texts = noise(500), noise(90), []
    for _ in range(30):
        own = list(base)
        for _ in range(source.randrange(4)):
            own[source.randrange(500)] = "Z"
        texts += ["".join(own), noise(source.randrange(60)) + passage + noise(60), noise(300), "ab" * 60 + noise(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert outcome(suffixes.remove_repeats(docs, width=40).collect()) == sorted(
        (i, *e) for i, e in enumerate(removed(texts, 40)))


def test_runs_do_not_depend_on_the_order_of_rows(monkeypatch):
    """A block is read three times, each time with its rows in any order."""
    monkeypatch.setattr(suffixes, "SLICE", 700)
    source = random.Random(4)
    texts = [None, "", *("".join(source.choice("abc d\n") for _ in range(source.randrange(400))) for _ in range(30))] * 2
    seen = set()
    for _ in range(4):
        source.shuffle(texts)
        found = suffixes._Runs(pa.array(texts, pa.string()), 40, 26, 3)
        assert [texts[i] or "" for i in found.order.to_pylist()] == sorted(t or "" for t in texts)
        seen.add((found.runs.value.tobytes(), found.runs.bucket.tobytes(), found.anchors.value.tobytes()))
    assert len(seen) == 1


def test_removal_with_rows_in_another_order_each_time(spark, monkeypatch):
    """As on a cluster, where blocks come from executors in any order."""
    source, runs = random.Random(6), suffixes._Runs

    def shuffled(texts, *rest):
        again = pa.array(np.random.default_rng().permutation(len(texts)))
        found = runs(texts.take(again), *rest)
        found.order = again.take(found.order)
        return found

    base = "".join(source.choice("abcdefgh \n") for _ in range(2000))
    texts = [base[source.randrange(1900) :][:300] + str(i) + base[: source.randrange(900)] for i in range(500)]
    monkeypatch.setattr(suffixes, "_Runs", shuffled)  # more text than one slice holds
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert outcome(suffixes.remove_repeats(docs, width=40).collect()) == sorted(
        (i, *e) for i, e in enumerate(removed(texts, 40)))
