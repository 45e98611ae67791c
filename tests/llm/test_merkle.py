"""The manifest against SQL and brute force; versions share what they don't change."""

import hashlib
import zlib

import pytest
from compare import connect, differences
from pyspark.sql import functions as F
from slicesync.llm import merkle
from slicesync.llm.queries import ORACLES, QUERIES


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, columns=merkle.LEAF_COLUMNS, more=0):
    out = ""
    for name in columns:
        value = row[name]
        if name == "n_chars" and value is not None:
            value += more
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return h(out)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def walk(tree, at, node):
    proof = ""
    for row in tree[:-1]:
        run = row[at // 2 * 2 : at // 2 * 2 + 2]
        proof += "".join(x for k, x in enumerate(run) if k != at % 2)
        run[at % 2] = node
        at, node = at // 2, h("".join(run))
    return proof, node


def brute(rows):
    keys = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, order = {}, {}
    for key in keys:
        own = [r for r in rows if r["lang"] == key]
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        order[key], trees[key] = own, levels([leaf(r) for r in own])
    top = levels([trees[k][-1][0] for k in keys])
    out = []
    for k, key in enumerate(keys):
        for at, row in enumerate(order[key]):
            tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            low, node = walk(trees[key], at, leaf(row, more=int(tampered)))
            high, node = walk(top, k, node)
            out.append((row["doc_id"], leaf(row), trees[key][-1][0], top[-1][0], h(low + high), node, node == top[-1][0]))
    return sorted(out, key=str)


def tampered(docs, **more):
    return merkle.manifest(
        docs, where=F.crc32(F.col("doc_id").cast("string")) % 7 == 0,
        changes={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, **more)


def test_against_sql(spark, sf_dir):
    name = "op12_merkle_manifest"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, place int, _tie int"


def rows_of(n):
    langs = ["en", None, "", "=", "é", "e"]
    out = [(i * 3, f"s{i % 4}" if i % 5 else None, langs[min(i % 9, 5)], i if i % 6 else None,
            "x" * i if i % 7 else None, "k", 1, 1) for i in range(n)]
    out += [(None, None, None, None, None, None, None, None)] * 2 + [(42, "r", "en", 5, "t", "k", 1, 1)] * 5
    return [*out, (42, "r", "en", 5, "u", "k", 1, 1), (7, "é", "lone", 2**63 - 2, "日本", "k", 1, 1)]


@pytest.mark.parametrize("depth", [1, 2, 12])
def test_against_brute_force(spark, depth):
    docs = spark.createDataFrame(rows_of(90), SCHEMA)
    got = tampered(docs, depth=depth).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == brute([r.asDict() for r in docs.collect()])
    for r in got:
        assert (r.copies is None) == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 0)
        assert r.copies is None or r.copies[-1] == r.folded_root


def test_no_rows_and_one_row(spark):
    assert tampered(spark.createDataFrame([], SCHEMA)).count() == 0
    row = tampered(spark.createDataFrame([(1, "s", "en", 1, "t", "k", 1, 1)], SCHEMA)).collect()
    assert [tuple(r)[:7] for r in row] == brute([dict(doc_id=1, source="s", lang="en", n_chars=1, text="t")])


def test_hot_key(spark):
    """One language holds nearly all rows, in many blocks."""
    docs = spark.range(700).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 50 == 0, "de").otherwise("en").alias("lang"),
        (F.col("id") % 11).alias("n_chars"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    got = tampered(docs, depth=3).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == brute([r.asDict() for r in docs.collect()])


def test_versions_share_untouched_nodes():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(13)]
    tree = merkle.PersistentTree(leaves, 4)
    nodes, base = len(tree.digest), list(tree.digest)
    for at in range(13):
        copies = tree.change(at, at, b"\0" * 32)
        assert len(copies) == 5 and tree.digest[:nodes] == base  # the leaf and four ancestors
        seen, stack = set(), [tree.roots[at]]
        while stack:
            node = stack.pop()
            seen.add(node)
            stack += tree.children[node]
        first = nodes + 5 * at
        assert {n for n in seen if n >= nodes} == set(range(first, first + 5))
        changed = [*leaves[:at], b"\0" * 32, *leaves[at + 1 :]]
        assert tree.digest[tree.roots[at]].hex() == levels([x.hex() for x in changed])[-1][0]
