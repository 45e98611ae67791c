"""The pipeline's stages, each against brute force on what the one before it kept."""

import corpus_pipeline
import pytest
from compare import connect
from slicesync.llm.queries import ORACLES
from slicesync.session import stage
from test_dedup import groups, removed
from test_tokens import check_packing, ids_of


def test_stages_are_named_and_ordered():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_pipeline_against_brute_force(spark, sf_dir, byte_bpe):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, results = docs.columns, [docs]
    for name, function in corpus_pipeline.STAGES:
        results.append(stage(function(spark, results[-1], sf_dir), f"test-{name}"))
    _, clean, distinct, left, packed = results
    assert clean.columns == distinct.columns == left.columns == columns

    sql = f"SELECT doc_id FROM ({ORACLES['op9_quality_rules']}) WHERE kept"
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in connect(sf_dir).execute(sql).fetchall())

    rows = clean.orderBy("doc_id").collect()
    _, names = groups([r.text for r in rows], 5, 80)
    kept = [r for k, r in enumerate(rows) if names[k] == k]
    assert distinct.orderBy("doc_id").collect() == kept

    expected = [(r.doc_id, text, len(text)) for r, (_, _, text) in zip(kept, removed([r.text for r in kept], 35))]
    assert [(r.doc_id, r.text, r.n_chars) for r in left.orderBy("doc_id").collect()] == expected

    used, least = check_packing(packed.collect(), ids_of(left, byte_bpe))
    assert used <= 1.02 * least + 1


@pytest.mark.parametrize("number", range(4))
def test_stages_take_odd_and_empty_tables(spark, edge_docs, no_docs, number):
    _, function = corpus_pipeline.STAGES[number]
    assert function(spark, no_docs, "").count() == 0
    out = function(spark, edge_docs, "")
    if number < 3:
        assert out.columns == edge_docs.columns and out.count() <= edge_docs.count()
    else:
        assert out.select("doc_id").distinct().count() == edge_docs.select("doc_id").distinct().count()
