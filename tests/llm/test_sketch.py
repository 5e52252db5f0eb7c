import hashlib

from demand_engine.llm import queries, sketch
from demand_engine.llm.common import read_table

from .helpers import TEXTS, documents


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_edited_text_and_order(spark, sf_small):
    texts = sorted(((r.doc_id, r.text) for r in read_table(spark, sf_small, "documents").collect()),
                   reverse=True)
    got = {r.doc_id: r for r in queries.op7_sketch(spark, sf_small).collect()}
    assert len(got) == len(texts)
    errors = []
    for k, (i, text) in enumerate(texts):
        follower = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + follower[:half]
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        if len(a) > 300:
            errors.append(abs(r.near_edited - len(a & b) / len(a | b)))
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert sum(errors) / len(errors) < 0.08


def test_awkward_documents(spark):
    out = sketch.with_next(documents(spark)).select(
        "doc_id", "text", "edited", sketch.fingerprint("sketch").alias("f"),
        sketch.likeness("sketch", "edited_sketch").alias("near")).collect()
    assert len(out) == len(TEXTS)
    by_text = {}
    for r in out:
        assert by_text.setdefault(r.text, r.f) == r.f
        assert (r.f == "") == (not r.text.split())
        assert r.near is not None
    last = next(r for r in out if r.doc_id is None)   # without id: last, followed by the first
    first = dict(TEXTS)[19]
    half = len(last.text) // 2
    assert last.edited == last.text[:len(last.text) - half] + first[:half]
    assert sketch.with_next(documents(spark).limit(0)).collect() == []


def test_single_document_follows_itself(spark):
    docs = spark.createDataFrame([(3, "a b c d e f g h")], "doc_id long, text string")
    assert sketch.with_next(docs).first().edited == "a b c d a b c d"[:8] + "a b c d e f g h"[:7]


def test_sketches_merge_and_estimate_containment(spark):
    long = " ".join(f"w{i}" for i in range(4000))
    docs = spark.createDataFrame([(1, long), (2, " ".join(long.split()[1000:1800]))],
                                 "doc_id long, text string")
    s = {r.doc_id: set(r.s) for r in docs.select("doc_id", sketch.sketch(docs.text).alias("s")).collect()}
    assert len(s[2] - s[1]) <= 1 and len(s[2]) > 50
    assert abs(len(s[1]) / (4000 / sketch.SCALE) - 1) < 0.2


def test_main_path_has_no_python(spark, sf_small):
    plan = queries.op7_sketch(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_merged_sketches_are_those_of_the_union(spark):
    """Parts that share four words hold every shingle of the whole, short ones and
    ones without a word included; merging is in any order and nesting."""
    words = [f"w{i}" for i in range(300)]
    rows = [(" ".join(words[:n + 4]), " ".join(words[n:]), " ".join(words)) for n in (1, 2, 3, 50, 290)]
    rows += [(" ".join(words[:m - 1]), " ".join(words[m - 5:m]), " ".join(words[:m])) for m in range(6, 40)]
    rows += [("", " ".join(words[:n]), " ".join(words[:n])) for n in range(12)]
    df = spark.createDataFrame(rows, "a string, b string, whole string").select(
        *[sketch.sketch(c).alias(c) for c in ("a", "b", "whole")])
    got = df.select("whole", sketch.merge("a", "b").alias("ab"), sketch.merge("b", "a").alias("ba"),
                    sketch.merge(sketch.merge("a", "b"), "whole").alias("again")).collect()
    assert any(len(r.whole) == 1 for r in got) and any(len(r.whole) > 50 for r in got)
    for r in got:
        assert r.ab == r.whole and r.ba == r.whole and r.again == r.whole
