import itertools
import tracemalloc
import zlib

import numpy as np
import pytest

from demand_engine.llm import queries, toxicity
from demand_engine.llm.common import read_table

from .helpers import TEXTS, documents


@pytest.fixture(scope="module")
def model(spark, sf_medium):
    return toxicity.fit(read_table(spark, sf_medium, "documents"),
                        read_table(spark, sf_medium, "labels"))


def test_viterbi_finds_the_cheapest_path(model):
    """Every path of small lattices, with costs added up one by one."""
    characters = model.characters
    for token in ("1d10t", "l0$er", "aa4b", "5c_um", "t-o"):
        columns = toxicity.lattice(token)
        best = None
        for path in itertools.product(*columns):
            x = y = 0
            cost = sum(extra for _, extra in path)
            for ch in "".join(out for out, _ in path) + " ":
                s = toxicity._symbol(ch)
                if s or y:
                    cost += characters[x, y, s]
                    x, y = y, s
            text = "".join(out for out, _ in path).strip()
            best = min(best or (cost, text), (cost, text))
        assert toxicity.viterbi(columns, characters) == best[1]


def test_noise_is_taken_out(model):
    restore = toxicity.Restorer(model.characters)
    for noisy, word in (("m0r0n", "moron"), ("tr@sh", "trash"), ("stuuuupid", "stupid"),
                        ("c-l-o-w-n", "clown"), ("idi0t!", "idiot"), ("5cum", "scum")):
        assert word in restore.words(f"of {noisy} the"), noisy
    assert "scum" in restore.words("you s c u m there")
    assert set(restore.words("Thing, of the “thin” ones.")) == {"thing", "of", "the", "thin", "ones"}


def test_every_noisy_token_is_decoded(model):
    restore = toxicity.Restorer(model.characters)
    joined = restore.words("you_are_a_stupid_idiot_and_a_worthless_clown")
    assert {"stupid", "idiot", "worthless", "clown"} <= set(joined)
    for mark in "_.-":
        text = mark.join(["the", "stupid", "idiot"] * 500)
        assert restore.words(text)["idiot"] > 400, mark
    for noisy, word in (("stu" + 40 * "u" + "pid", "stupid"), ("1d107", "idiot"), ("1d1o7", "idiot")):
        assert word in restore.words(f"of {noisy} the"), noisy
    assert "".join(restore.words("a55")).isalpha()  # as or ass, as the model says
    for spaced in ("s - t - u - p - i - d", "s t - u p ... i d", "s -- t _ u _ p _ i _ d"):
        assert "stupid" in restore.words(f"you {spaced} there"), spaced
    assert not restore.words("- -- ... - ---")


def test_long_tokens_cost_linear_memory(model):
    columns = toxicity.lattice("i1" * 200_000)
    tracemalloc.start()
    text = toxicity.viterbi(columns, model.characters)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) >= 200_000 and peak < 200e6


def test_held_out_documents(spark, sf_medium):
    labels = {r.doc_id: r.toxic for r in read_table(spark, sf_medium, "labels").collect()}
    got = queries.op6_toxicity(spark, sf_medium).collect()
    assert len(got) == read_table(spark, sf_medium, "documents").count()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    hits = sum(r.predicted and labels[r.doc_id] for r in held)
    assert hits >= 0.7 * sum(labels[r.doc_id] for r in held)
    assert sum(r.predicted and not labels[r.doc_id] for r in held) <= 0.02 * len(held)


def test_obfuscated_documents_score_like_plain_ones(spark, sf_medium):
    plain = "The thing of ones idiot there with a moron and the worthless clown, stupid loser."
    noisy = "The thing of ones 1diot there with a m0r0n and the w0rthless cl0wn, stuuupid l0ser."
    clean = "The thing of ones there with a thin and the tion thble, and the erst."
    docs = read_table(spark, sf_medium, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_medium, "labels"))
    few = documents(spark, [(1, plain), (2, noisy), (3, clean)])
    score = toxicity.scorer(docs, model)
    got = {r.doc_id: r.s for r in few.select("doc_id", score("text").alias("s")).collect()}
    assert got[1] >= 0.7 and got[2] >= 0.7 and got[3] < 0.1


def test_awkward_documents_and_labels(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(8, 1, 1), (9, None, 0), (None, 0, 1), (5, 1, None), (5, 0, 1),
                                    (999, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0), labels.filter("toxic = 0")):
        got = toxicity.toxic_scores(docs, given).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score < 0.7 for r in got)
    kept = toxicity.keep_clean(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    assert toxicity.toxic_scores(docs.limit(0), labels).collect() == []


def test_language_model_counts_every_text(spark):
    docs = documents(spark, [(1, "ab ab"), (2, "Ab!"), (3, None), (4, "äb")])
    cube = toxicity.trigram_counts(docs)
    assert cube[0, 1, 2] == 3 and cube[1, 2, 0] == 3 + 0 and cube[0, 27, 2] == 1
    assert np.isclose(np.exp(-toxicity.language_model(cube)).sum(axis=2), 1).all()
