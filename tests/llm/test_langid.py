import zlib

import numpy as np

from demand_engine.llm import langid, queries
from demand_engine.llm.common import read_table

from .helpers import TEXTS, documents


def test_held_out_accuracy(spark, sf_medium):
    docs = {r.doc_id: r for r in read_table(spark, sf_medium, "documents").collect()}
    got = queries.op3_language_id(spark, sf_medium).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_kernel_counts_shared_ngrams():
    texts = ["The cat, the hat!", "A cat sat", "ÄÖ ü", "the the the", "x"]
    model = langid.train(texts, ["a", "b", "a", "b", "a"], landmarks=3)

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        s = " " + " ".join(words) + " "
        return {s[i:i + n] for n in langid.ORDERS for i in range(len(s) - n + 1)}

    present = np.zeros(1 << langid.BITS, np.uint8)
    got = model.kernel([langid.ngrams(t, present) for t in texts])
    assert not present.any()
    order = [0, 2, 4, 1, 3]                    # landmarks by language, in sample order
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[k] for k in order):
            want = len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
            assert abs(got[i, j] - want) < 1e-5


def test_nystrom_with_all_landmarks_is_kernel_ridge():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc ")) for _ in range(40)) + "q" for _ in range(12)] + \
            ["".join(rng.choice(list("xyz ")) for _ in range(40)) + "q" for _ in range(12)]
    labels = ["l"] * 12 + ["r"] * 12
    model = langid.train(texts, labels, landmarks=12)
    predicted, scores = model.predict(texts)
    assert predicted == labels and min(scores) > 0.5
    present = np.zeros(1 << langid.BITS, np.uint8)
    k = model.kernel([langid.ngrams(t, present) for t in texts]).astype(float)
    alpha = np.linalg.solve(k + langid.RIDGE * len(texts) * np.eye(len(texts)),
                            np.array([[1.0, -1.0]] * 12 + [[-1.0, 1.0]] * 12))
    assert np.abs(k @ alpha - k @ model.projection).max() < 0.02


def test_awkward_documents(spark):
    docs = documents(spark, [(i, t) for i, t in TEXTS if i != 8])
    got = langid.languages(docs, langid.fit(docs)).collect()
    assert len(got) == len(TEXTS) - 1
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    empty = langid.fit(docs.limit(0))
    assert all(r.lang_pred == "und" for r in langid.languages(docs, empty).collect())
    assert langid.languages(docs.limit(0), empty).collect() == []
