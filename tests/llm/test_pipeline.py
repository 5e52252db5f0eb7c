import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from demand_engine.llm import bpe, decontaminate, pii, toxicity
from demand_engine.llm.common import read_table

from .helpers import documents
from .test_pii import brute_base
from .test_simhash import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def outputs(spark, sf_medium):
    """Each stage's input and output, written in between as the pipeline does."""
    docs, out = read_table(spark, sf_medium, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, docs, sf_medium))
        out.append((name, docs, after))
        docs = after
    return out


def test_columns(outputs):
    for name, before, after in outputs[:-1]:
        assert after.dtypes == before.dtypes, name


def test_toxic_documents_go_and_others_stay(spark, sf_medium, outputs):
    _, before, after = outputs[0]
    labels = {r.doc_id: r.toxic for r in read_table(spark, sf_medium, "labels").collect()}
    kept = {r.doc_id for r in after.collect()}
    clean = [i for i, toxic in labels.items() if not toxic]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)
    scores = {r.doc_id: r.score for r in toxicity.toxic_scores(
        before, read_table(spark, sf_medium, "labels")).collect()}
    assert kept == {i for i, s in scores.items() if s < toxicity.THRESHOLD}


def test_one_document_of_each_group_stays(outputs):
    _, before, after = outputs[1]
    texts = {r.doc_id: r.text for r in before.collect()}
    component = brute_components([(i, brute_fingerprint(t)) for i, t in texts.items()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(component.values()))
    assert all(texts[r.doc_id] == r.text for r in after.collect())


def test_leaks_go(spark, sf_medium, outputs):
    _, before, after = outputs[2]
    items = [r.text for r in read_table(spark, sf_medium, "benchmark").collect()]
    kept = {r.doc_id for r in after.collect()}
    leaking = {r.doc_id for r in decontaminate.leaks(
        before, read_table(spark, sf_medium, "benchmark")).collect()}
    for r in before.collect():
        assert (r.doc_id in kept) == (r.doc_id not in leaking)
        assert r.doc_id not in kept or not any(item in r.text for item in items)


def test_personal_data_is_gone(outputs):
    _, before, after = outputs[3]
    texts = {r.doc_id: r.text for r in after.collect()}
    assert len(texts) == before.count()
    touched = 0
    for r in before.collect():
        assert brute_base(texts[r.doc_id]) == ""
        touched += brute_base(r.text) != ""
        if not pii.candidates(r.text):
            assert texts[r.doc_id] == r.text
    assert touched > 10


def test_tokens_of_what_is_left(outputs):
    _, before, after = outputs[4]
    library = tiktoken.Encoding(
        "ours", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=bpe.load_ranks(
            public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    got = {r.doc_id: r for r in after.collect()}
    assert len(got) == before.count()
    for r in before.collect():
        ids = library.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_is_the_stages_in_order(spark, sf_medium, outputs):
    want = sorted(map(tuple, outputs[-1][2].collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_medium).collect())) == want


def test_awkward_documents_pass_every_stage(spark, sf_medium):
    docs = documents(spark)
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, sf_medium)
            assert out.columns == given.columns, name
            given = corpus_pipeline.materialize(out)
        assert stage(spark, given, sf_medium).count() == given.count()
