import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from demand_engine.llm import pii, queries
from demand_engine.llm.common import read_table

from .helpers import TEXTS, documents


def digits(s):
    return re.sub("[^0-9]", "", s)


def brute_luhn(s):
    doubled = [int(c) * 2 if k % 2 else int(c) for k, c in enumerate(reversed(s))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def brute_base(text):
    out = [("email", *m.span()) for m in
           re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 13 <= len(digits(m[0])) <= 19 and brute_luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def ours(text):
    found = [(k, a, b) for k, a, b, holds in pii.base_matches(text) if holds]
    return pii.joined(found)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("0123456789.-+ ()@ab_%é"), max_size=60))
def test_base_matches_as_by_plain_patterns(text):
    assert ours(text) == brute_base(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.de", "@", "x@y", "10.0.0.1", "256.1.1.1", "4556737586899855", " ",
                                 "+1 (246) 555-8210", ".", "-", "٣", "a@b.c@d.e"]), max_size=8))
def test_base_matches_of_glued_pieces(pieces):
    assert ours("".join(pieces)) == brute_base("".join(pieces))


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+" + "(" * 100_000,
                 "1 " * 100_000, "a@" * 50_000, "a at " * 50_000 + "dot"):
        pii.candidates(text)


def test_query_on_the_whole_table(spark, sf_medium):
    texts = {r.doc_id: r.text for r in read_table(spark, sf_medium, "documents").collect()}
    got = queries.op2_pii(spark, sf_medium).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        for kind in pii.BASE_KINDS:
            assert r[f"n_{kind}"] == len(re.findall(rf"\b{kind}:", base))
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.4
    hit = np.array([0.97, 0.8, 0.6, 0.9, 0.7])
    false = np.array([0.10, 0.2, 0.3, 0.05, 0.3])
    says = np.where(truth[:, None], rng.random((20_000, 5)) < hit, rng.random((20_000, 5)) < false)
    patterns, n = np.unique(np.where(says, 1, -1), axis=0, return_counts=True)
    post, table = pii.estimate(patterns, n.astype(float))
    assert np.abs(table[1:, 1, 2] - hit[1:]).max() < 0.05
    assert np.abs(table[1:, 0, 2] - false[1:]).max() < 0.05
    lookup = {tuple(p): q for p, q in zip(patterns.tolist(), post)}
    called = np.array([lookup[tuple(v)] >= 0.5 for v in np.where(says, 1, -1).tolist()])
    assert (called == truth).mean() > 0.95


@pytest.mark.parametrize("size", [2_000, 200_000])
def test_em_estimates_the_validator_too(size):
    """Half as many expected votes as candidates: the estimate lies between, nearer to
    the data, and alike at every size."""
    rng = np.random.default_rng(3)
    truth = rng.random(size) < 0.5
    hit, false = np.array([0.80, 0.9, 0.9, 0.9]), np.array([0.25, 0.1, 0.1, 0.1])
    says = np.where(truth[:, None], rng.random((size, 4)) < hit, rng.random((size, 4)) < false)
    patterns, n = np.unique(np.where(says, 1, -1), axis=0, return_counts=True)
    _, table = pii.estimate(patterns, n.astype(float))
    assert abs(table[0, 1, 2] - (0.80 + 0.97 / 2) / 1.5) < 0.04
    assert abs(table[0, 0, 2] - (0.25 + 0.10 / 2) / 1.5) < 0.04


def test_rare_patterns_count_fully_in_large_tables():
    x = np.array([[0.0], [1.0]])
    few = pii.logistic(x, np.array([0.001, 0.95]), np.array([1e4, 1e3]))
    many = pii.logistic(x, np.array([0.001, 0.95]), np.array([1e8, 1e3]))
    for w in (few, many):
        assert 1 / (1 + np.exp(-w.sum())) > 0.9
    sure = pii.logistic(x, np.array([0.0, 1.0]), np.array([1e9, 1e9]))
    assert np.isfinite(sure).all() and 1 / (1 + np.exp(-sure.sum())) > 0.999


def test_further_kinds_and_redaction(spark):
    texts = [(i, f"noise {i} call 246-555-{1000 + i} now, born 12.03.19{10 + i % 80} ok, Mr John Smith "
                 f"spoke, ssn 123-45-{6000 + i}, mail joe{i} at site dot com, version 1.2.{i}, "
                 f"card 4556737586899850") for i in range(60)]
    docs = documents(spark, texts)
    model = pii.fit(docs)
    found = {r.doc_id: r.spans for r in pii.find_all(docs, model).collect()}
    kinds = {s.split(":")[0] for s in found[5].split(",")}
    assert {"phone_local", "birth", "name", "identity", "email_written"} <= kinds and "card" not in kinds
    assert model.reliability["phone_local"]["cue_near"][0] > 0.5
    out = {r.doc_id: r for r in pii.redacted(docs, model).collect()}
    assert pii.redacted(docs, model).columns == docs.columns
    assert "[PHONE_LOCAL]" in out[5].text and "John" not in out[5].text
    assert out[5].n_chars == len(out[5].text)


def test_awkward_documents(spark):
    docs = documents(spark)
    model = pii.fit(docs)
    got = pii.find_all(docs, model).collect()
    assert len(got) == len(TEXTS)
    spans = next(r.spans for r in got if r.doc_id == 18)
    assert [s.split(":")[0] for s in spans.split(",")][:4] == ["email", "ip", "card", "phone"]
    out = pii.redacted(docs, model).collect()
    assert next(r.text for r in out if r.doc_id == 18) == \
        "12345 [PHONE] mail me: [EMAIL], [IP], [CARD]"
    assert next(r.text for r in out if r.doc_id == 1) is None
    assert pii.fit(docs.limit(0)).weights == {}
    assert pii.find_all(docs.limit(0), model).collect() == []
