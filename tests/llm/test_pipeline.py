from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.brute import near_components

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def staged(spark, sf_dir, tmp_path_factory):
    """Each stage's input and output."""
    out, docs = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_columns_and_order(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "personal_data", "mixing", "tokens"]
    for name in list(STAGES)[:-1]:
        assert staged[name][1].dtypes == staged[name][0].dtypes


def test_toxic_documents_go_and_clean_ones_stay(spark, sf_dir, staged):
    kept = {r.doc_id for r in staged["toxicity"][1].collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [i for i, t in labels.items() if not t]
    assert sum(i in kept for i in clean) / len(clean) > 0.97


def test_one_of_each_group_stays(staged):
    before, after = ([(r.doc_id, r.text) for r in df.collect()] for df in staged["near_dedup"])
    component = near_components(before)
    assert sorted(i for i, _ in after) == sorted({c for n, c in component.values() if n} | {i for i, (n, _) in component.items() if not n})


def test_no_personal_data_is_left(staged):
    from tests.llm.brute import base_spans

    assert sum(len(base_spans(r.text)) for r in staged["personal_data"][0].collect()) > 0
    assert not [s for r in staged["personal_data"][1].collect() for s in base_spans(r.text)]
    assert all(r.n_chars == len(r.text) for r in staged["personal_data"][1].collect())


def test_tokens_hold_the_texts(staged):
    before, after = staged["tokens"]
    assert sorted(r.text for r in before.collect()) == sorted(r.decoded for r in after.collect())
    assert all(r.parity and r.n_tokens == len(r.tokens) for r in after.collect())


def test_run_gives_the_stages_rows(spark, sf_dir, staged):
    got = sorted((r.doc_id, tuple(r.tokens)) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted((r.doc_id, tuple(r.tokens)) for r in staged["tokens"][1].collect())


def test_empty_table_passes_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
