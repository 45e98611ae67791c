"""Substring, MinHash and embedding dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences
from conftest import words
from slicesync.llm import embeddings, minhash, substrings
from slicesync.llm.components import components
from slicesync.llm.queries import ORACLES, QUERIES


def removed(texts, width):
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def groups(texts, width, percent):
    """Component of each text's position, by comparing all sets that share a shingle."""
    sets = []
    for t in texts:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    name, holders = list(range(len(texts))), defaultdict(list)

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for k, own in enumerate(sets):
        shared = Counter(j for g in own for j in holders[g])
        for g in own:
            holders[g].append(k)
        for j, both in shared.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                a, b = sorted((find(j), find(k)))
                name[b] = a
    return sets, [find(k) for k in range(len(texts))]


def test_substrings_of_the_table(spark, sf_dir):
    rows = {r.doc_id: tuple(r)[1:] for r in QUERIES["op3_substring_dedup"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    for r, (n, gone, text) in zip(docs, removed([r.text for r in docs], 35)):
        assert rows[r.doc_id] == (n, gone, hashlib.sha256(text.encode()).hexdigest())
    assert len(rows) == len(docs)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_substrings_of_edge_cases(edge_docs, no_docs, width, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 500)  # many blocks and buckets
    monkeypatch.setattr(substrings, "BUCKET_WINDOWS", 50)
    docs = edge_docs.collect()
    got = substrings.remove_repeats(edge_docs, width=width).collect()
    expected = removed([r.text for r in docs], width)
    assert sorted((r.row.doc_id or -1, r.n_words, r.n_removed, r.text) for r in got) == sorted(
        (r.doc_id or -1, *e) for r, e in zip(docs, expected))
    for r in got:
        assert sum(s.stop - s.start for s in r.removed) == r.n_removed
        assert all(a.stop < b.start for a, b in zip(r.removed, r.removed[1:]))
    assert substrings.remove_repeats(no_docs).count() == 0
    assert substrings.without_repeats(edge_docs, width=width).columns == edge_docs.columns


def test_minhash_of_the_table(spark, sf_dir):
    rows = {r.doc_id: r for r in QUERIES["op10_minhash_near_dedup"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    sets, names = groups([r.text for r in docs], 4, 80)
    for k, r in enumerate(docs):
        expected = (len(sets[k]), docs[names[k]].doc_id, names[k] == k)
        assert (rows[r.doc_id].n_shingles, rows[r.doc_id].component_id, rows[r.doc_id].kept) == expected


def test_minhash_of_edge_cases(edge_docs, no_docs):
    rows = minhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[15].component_id == 14 and not by_id[15].kept and by_id[14].kept
    assert by_id[None].component_id is None and by_id[None].kept
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept for i in (0, 1, 2, 3))
    assert minhash.near_duplicates(no_docs).count() == 0
    stay = minhash.one_of_each(edge_docs)
    assert stay.columns == edge_docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in stay.collect()) == [-1, *(i for i in range(18) if i != 15)]


def test_columns_with_clashing_names_stay(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", 7, "x", 1, 2), (2, "a b c d e f", 8, "y", 3, 4), (3, None, 9, "z", 5, 6)],
        "doc_id long, text string, _row_id long, _row_text string, ROW_ID int, row_text int")
    stay = minhash.one_of_each(docs)
    assert stay.columns == docs.columns
    assert sorted(map(tuple, stay.collect())) == [(1, "a b c d e f", 7, "x", 1, 2), (3, None, 9, "z", 5, 6)]


def test_rows_of_one_id_with_different_texts_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (3, c), (4, c), (4, c), (5, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stay = minhash.one_of_each(docs).collect()
    assert sorted(map(tuple, stay), key=str) == sorted([(1, a), (1, b), (3, c), (5, ""), (5, None)], key=str)


@pytest.fixture(scope="module")
def hot(spark):
    """A third near copies of one text (a chain of small edits), a common passage, noise."""
    random = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    passage, texts = [f"p{i}" for i in range(60)], []
    for k in range(120):
        own = list(base)
        for at in random.choice(120, random.integers(0, 5), replace=False):
            own[at] = f"e{k}x{at}"
        texts.append(" ".join(own))
    texts += [" ".join([*passage, *(f"q{k}y{i}" for i in range(random.integers(10, 70)))]) for k in range(120)]
    texts += [" ".join(f"z{random.integers(0, 40)}" for _ in range(random.integers(1, 30))) for _ in range(120)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts


@pytest.mark.parametrize("tile", [64, 4])
def test_minhash_loses_no_link_of_a_hot_group(hot, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "CHUNK", 32)
    docs, texts = hot
    _, names = groups(texts, 5, 80)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(texts))] == names


def test_no_pair_is_lost_by_its_sketch(spark):
    """Pairs of exactly 0.8 whose common words fall into few bins, the others into one each."""
    each = [f"w{i}" for i in range(20_000)]
    bins = defaultdict(list)
    for word, value in zip(each, minhash.Sets(pa.array(each), 1).values):
        bins[int(value) >> 57].append(word)  # sets of 90 have 128 bins
    texts = []
    for k in range(8):
        common = [w for at in range(k * 4, k * 4 + 4) for w in bins[at][:20]]
        own = [bins[at][k] for at in range(100, 120)]
        texts += [" ".join(common + own[:10]), " ".join(common + own[10:])]
    got = {r.doc_id: r for r in minhash.near_duplicates(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=1).collect()}
    _, names = groups(texts, 1, 80)
    assert names == [k // 2 * 2 for k in range(16)]
    assert [got[k].component_id for k in range(16)] == names


@pytest.fixture(scope="module")
def long_documents(spark):
    """400 documents of 3,200 words that share 60 % of them, none similar enough but for a few."""
    random = np.random.default_rng(11)
    common = [f"c{i}" for i in range(1920)]
    texts = [" ".join([*common, *(f"u{k}x{i}" for i in range(1280))]) for k in range(400)]
    for k in (3, 7, 50, 399):  # near copies, some of them of copies
        own = texts[k - 3].split()
        for at in random.choice(len(own), 40, replace=False):
            own[at] = f"e{k}x{at}"
        texts[k] = " ".join(own)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts


def test_long_documents_that_share_a_passage(long_documents, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 128)
    suspects, forests = [], []
    for name, kept in (("_suspects", suspects), ("_forest", forests)):
        plain = getattr(minhash, name)
        monkeypatch.setattr(minhash, name, lambda *a, plain=plain, kept=kept: kept.append(plain(*a)) or kept[-1])
    docs, texts = long_documents
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert [got[k] for k in range(400)] == groups(texts, 5, 80)[1]
    assert got[3] == 0 and got[7] == 4 and got[399] == 396
    # Only members with a possible partner come back with their texts, and no pair leaves a task.
    assert suspects[0].count() <= 20 and forests[0].count() <= suspects[0].count()


def test_a_block_emits_a_spanning_forest(spark):
    """All 60 are near copies of each other, but only through one another: a chain of edits."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join([f"e{i}" for i in range(k)] + words[k:]) for k in range(0, 300, 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = minhash.signatures(docs.selectExpr("doc_id", "text", "0L AS text_hash"), 5, 1, 1)
    members = signed.join(docs, "doc_id").selectExpr(
        "1L AS key", "0L AS chunk", "doc_id AS cls", "doc_id AS component", "true AS left", "true AS right",
        "n_shingles", "sketch", "array(1L) AS first", "array(1L) AS second", "0 AS table", "text")
    links = [tuple(r) for r in minhash._forest(members, 5, 80).collect()]
    assert len(links) == 59
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert [got[k] for k in range(60)] == groups(texts, 5, 80)[1] == [0] * 60
    assert {r.cls for r in minhash._suspects(members, 80).collect()} == set(range(60))


def test_sketches_fold():
    sets = minhash.Sets(pa.array([" ".join(f"w{i}" for i in range(n)) for n in (40, 100, 700, 3000)]), 1)
    for k, sketch in enumerate(minhash._sketches(sets)):
        bins = len(sketch)
        assert bins == max(64, 1 << (len(sets[k]) - 1).bit_length())
        shift = 64 - (bins // 4).bit_length() + 1
        folded = minhash._folded(np.frombuffer(sketch, np.uint8)[None, :], bins // 4)[0]
        for at in range(bins // 4):
            own = [int(v) for v in sets[k] if int(v) >> shift == at]
            assert folded[at] == (1 + min(own) % 254 if own else 0)


def test_sketches_bound_what_sets_can_share():
    size = np.array(810)  # two such sets need 720 in common
    assert minhash._possible(np.array([180, 181, 182]), size, size, 80).tolist() == [True, False, False]
    assert not minhash._possible(np.array(0), np.array(79), np.array(100), 80)


@pytest.mark.parametrize("main", [0, 70])
def test_a_bucket_of_many_components_is_dealt_into_bounded_groups(spark, monkeypatch, main):
    monkeypatch.setattr(minhash, "CHUNK", 32)
    members = range(300)
    part = {c: 1000 if c < main else c for c in members}
    met = spark.createDataFrame(
        [(1, 5, c) for c in members] + [(2, 7, 0), (2, 7, 299)], "key long, table int, cls long")
    names = spark.createDataFrame([(c, 1000) for c in range(main)], "node long, component long")
    classes = spark.createDataFrame([(c, 9) for c in members], "cls long, n_shingles long")
    rows, pairs = defaultdict(list), Counter()
    for r in minhash._unsettled(met, names, classes).collect():
        rows[r.key, r.chunk].append(r)
    for (key, _), group in rows.items():
        assert len(group) <= 3 * 32
        for a in group:
            for b in group:
                if key == 1 and a.left and b.right and a.component != b.component:
                    pairs[min(a.cls, b.cls), max(a.cls, b.cls)] += 1
    assert set(pairs) == {(a, b) for a in members for b in members if a < b and part[a] != part[b]}


def test_tables_are_pairs_of_two_collections(spark, hot):
    docs, _ = hot
    signed = minhash.signatures(docs.selectExpr("doc_id", "text", "0L AS text_hash"), 5, 3, 2)
    row = signed.where("doc_id = 0").first()
    assert len(row["first"]) == len(row["second"]) == 3 and len(row.sketch) == 128
    assert minhash._table_keys(signed.withColumnRenamed("doc_id", "cls")).where("cls = 0").count() == 9


def test_components_of_chains_stars_and_copies(spark):
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(7, k) for k in range(20, 60)]
    links = spark.createDataFrame([*chain, *star, (3, 3), (5, 4), (4, 5)], "a long, b long")
    got = dict(components(links).collect())
    assert all(got[k] == 100 for k in range(100, 141)) and all(got[k] == 7 for k in range(20, 60))
    assert got[5] == got[4] == 4 and 3 not in got
    assert components(links.limit(0)).count() == 0


def vectors(random, copies=40):
    base = random.standard_normal((30, 16)).astype(np.float32)
    near = (base[0] + random.standard_normal((copies, 16)) * 0.03).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate([*base, *near, *([base[1]] * copies)])]
    n = len(rows)
    return rows + [
        (n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1),
        (n + 4, base[2].tolist(), None), (n + 5, base[2].tolist()[:8], 2), (n + 6, [], 2),
        (n + 7, (base[2] * 7).tolist(), 2), (n + 8, [float("inf")] * 16, 1)]


def brute_vectors(rows):
    real = [(i, np.array(v, float), label) for i, v, label in rows if v and label is not None
            and None not in v and np.isfinite(v).all() and np.any(v)]
    links = defaultdict(set)
    for i, v, label in real:
        for j, w, other in real:
            if i != j and label == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i].add(j)
    out = {}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors(np.random.default_rng(1))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "1 AS n", "2 AS cls")
    got = {r.vec_id: tuple(r)[1:] for r in embeddings.near_duplicates(frame).collect()}
    assert got == brute_vectors(rows)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0
    assert embeddings.near_duplicates(frame.where("embedding IS NULL")).first() == (rows[-9][0], 0, rows[-9][0], True)


def test_vectors_agree_with_sql(spark, sf_dir):
    name = "op4_embedding_near_dedup"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []


def test_recall_at_the_threshold():
    random = np.random.default_rng(2)
    unit = embeddings._unit(random.standard_normal((2000, 64)))
    away = random.standard_normal(unit.shape)
    away -= (away * unit).sum(axis=1, keepdims=True) * unit
    near = 0.98 * unit + np.sqrt(1 - 0.98**2) * embeddings._unit(away)
    tables = embeddings.Tables(unit[:1000], 10, 0.98, 0.998)
    met = (tables.keys(unit) == tables.keys(near)).any(axis=1)
    assert met[1000:].mean() >= 0.99


def test_windows_hash_alike_wherever_they_stand():
    from slicesync.llm.batches import words_of
    from slicesync.llm.hashing import BASES, inner_windows, window_hashes, word_hashes

    codes, offsets, distinct = words_of(pa.array(["a b c d", "x a b c", "a b"]))
    values = window_hashes(word_hashes(distinct)[codes, 0], 3, BASES[0])
    inner = np.flatnonzero(inner_windows(offsets, 3))
    assert inner.tolist() == [0, 1, 4, 5] and values[0] == values[5] and len(set(values[inner])) == 3
