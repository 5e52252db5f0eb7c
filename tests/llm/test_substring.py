import hashlib
import random
import re

import numpy as np
import pytest

from demand_engine.llm import queries, substring
from demand_engine.llm.common import read_table

from .helpers import TEXTS, documents, rows


def brute(texts, window):
    """(doc_id, n_words, n_removed, kept) by comparing all windows."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    first = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = {p for k in range(len(words) - window + 1) if i is not None
                and first[tuple(words[k:k + window])] < i for p in range(k, k + window)}
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), kept))
    return sorted(out, key=repr)


def test_awkward_documents(spark):
    assert rows(substring.remove_repeats(documents(spark))) == brute(TEXTS, 50)


@pytest.mark.parametrize("seed", range(3))
def test_small_vocabulary_with_shared_passages(spark, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abc") for _ in range(rng.randint(5, 20))] for _ in range(6)]
    texts = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.6 else [rng.choice("abcdefgh")
                                                                      for _ in range(rng.randint(1, 9))]
        texts.append((rng.randint(0, 45), " ".join(words)))      # some ids twice
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(substring.remove_repeats(docs, window=7, seed_words=3)) == brute(texts, 7)


def test_factors_point_at_equal_words(spark):
    shared = [f"p{i}" for i in range(80)]
    texts = {1: shared + ["x"] * 9, 2: ["y"] * 5 + shared, 3: ["z"] * 4 + shared[10:70]}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    found = substring.factors(docs).collect()
    assert {(f.doc_id, f.start, f.n_words, f.ref_doc_id, f.ref_start) for f in found} == {
        (2, 5, 80, 1, 0), (3, 4, 60, 1, 10)}
    for f in found:
        assert texts[f.doc_id][f.start:f.start + f.n_words] == \
            texts[f.ref_doc_id][f.ref_start:f.ref_start + f.n_words]


def parsed(texts, window):
    """Greedy factors by comparing words: ``(doc_id, start, n_words, ref_doc_id)``.
    ``texts``: one text for each doc_id."""
    texts = {i: w for i, w in sorted(texts.items())}
    first = {}
    for i, words in texts.items():
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k:k + window]), (i, k))
    out = []
    for i, words in texts.items():
        owner = [first[tuple(words[k:k + window])] for k in range(len(words) - window + 1)]
        lo = 0
        while lo < len(owner):
            if owner[lo][0] == i:
                lo += 1
                continue
            hi = next((k for k in range(lo, len(owner)) if owner[k][0] == i), len(owner))
            parts = {}                            # of each reference, in windows
            for k in range(lo, hi):
                r, at = owner[k]
                a, z = parts.get(r, (at, at))
                parts[r] = min(a, at - k + lo), max(z, at - k + hi)
            q = lo
            while q < hi:
                best = (0, 0)
                for r, (a, z) in parts.items():
                    end = min(z + window - 1, len(texts[r]))
                    for at in range(max(a, 0), end):
                        n = 0
                        while (q + n < hi + window - 1 and at + n < end
                               and words[q + n] == texts[r][at + n]):
                            n += 1
                        best = max(best, (n, -r))
                out.append((i, q, best[0], -best[1]))
                q += best[0] - window + 1
            lo = hi
    return sorted(out)


def check_factors(spark, texts, window, seed_words):
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()],
                                 "doc_id long, text string")
    found = substring.factors(docs, window=window, seed_words=seed_words).collect()
    assert sorted((f.doc_id, f.start, f.n_words, f.ref_doc_id) for f in found) == parsed(texts, window)
    for f in found:
        assert texts[f.doc_id][f.start:f.start + f.n_words] == \
            texts[f.ref_doc_id][f.ref_start:f.ref_start + f.n_words]
    return found


def test_a_factor_is_the_longest_match(spark):
    """Document 1 holds the middle of a passage, 2 all of it: 3 and 4 are one factor each."""
    p = [f"p{i}" for i in range(200)]
    texts = {1: p[60:130], 2: p, 3: ["x", "y", "z"] + p, 4: p[60:190] + ["end"],
             5: ["a"] * 300, 6: ["b"] + ["a"] * 400, 7: p[:60] * 7, 8: ["c"] + p[:60] * 5 + ["d"],
             9: p[150:] + p[:60] * 9}
    found = check_factors(spark, texts, 50, 20)
    assert {(f.start, f.n_words, f.ref_doc_id) for f in found if f.doc_id == 3} == {(3, 200, 2)}
    assert {(f.start, f.n_words, f.ref_doc_id) for f in found if f.doc_id == 4} == {(0, 130, 2)}


@pytest.mark.parametrize("seed", range(3))
def test_factors_against_a_plain_parser(spark, seed):
    rng = random.Random(seed)
    pool = [rng.choice("abc") for _ in range(90)]
    texts = {}
    for i in range(40):
        words = [f"own{i}"]                       # texts differ from each other
        for _ in range(rng.randint(1, 5)):
            at = rng.randint(0, 60)
            words += pool[at:at + rng.randint(5, 30)] if rng.random() < 0.8 else ["z"]
        texts[i] = words
    check_factors(spark, texts, 6, 3)


def test_longest_matches_by_comparison():
    rng = random.Random(5)
    for _ in range(40):
        text, other = ([rng.choice((0, 1, 2)) for _ in range(rng.randint(1, 30))] for _ in range(2))
        length, place = substring.longest_matches(np.array(text), np.array(other))
        for q in range(len(text)):
            n = max(k for k in range(len(text) - q + 1)
                    if any(other[a:a + k] == text[q:q + k] for a in range(len(other) + 1)))
            assert length[q] == n and other[place[q]:place[q] + n] == text[q:q + n]


def test_query_on_the_whole_table(spark, sf_small):
    texts = [(r.doc_id, r.text) for r in read_table(spark, sf_small, "documents").collect()]
    want = sorted(((i, n, g, hashlib.sha256(k.encode()).hexdigest())
                   for i, n, g, k in brute(texts, 50)), key=repr)
    assert rows(queries.op8_substring_dedup(spark, sf_small)) == want


def test_empty_table(spark):
    assert substring.remove_repeats(documents(spark).limit(0)).collect() == []


def test_a_passage_that_most_texts_share(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [(i, f"own{i} " * (i % 4) + passage + f" end{i}" * (i % 3)) for i in range(400)] + \
        [(1000 + i, " ".join(f"q{i}x{k}" for k in range(60))) for i in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert rows(substring.remove_repeats(docs)) == brute(texts, 50)
