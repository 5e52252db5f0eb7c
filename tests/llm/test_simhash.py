import random
import re

import numpy as np
import xxhash

from demand_engine.llm import queries, simhash
from demand_engine.llm.common import read_table
from demand_engine.llm.components import connected_components

from .helpers import TEXTS, documents, rows


def brute_fingerprint(text, shingle=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    parts = [" ".join(words[i:i + shingle]) for i in range(max(len(words) - shingle + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Groups:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def brute_components(fps, distance=4):
    """fps: (doc_id, fingerprint); component of each doc_id, over all pairs."""
    groups = Groups()
    for i, (a, x) in enumerate(fps):
        groups.find(a)
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= distance:
                groups.join(a, b)
    return {a: groups.find(a) for a, _ in fps}


def test_fingerprints_and_components_of_awkward_documents(spark):
    fps = [(i, brute_fingerprint(t)) for i, t in TEXTS]
    component = brute_components([f for f in fps if f[0] is not None])
    by_fp = {fp: component[i] for i, fp in fps if i is not None}
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id)
                  for r in simhash.near_duplicates(documents(spark)).collect()), key=repr)
    want = sorted(((i, fp, by_fp.get(fp)) for i, fp in fps), key=repr)
    # rows that repeat a doc_id with another text are in that id's component too
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert {g[0]: g[2] for g in got if g[0] in (1, 2, 3, 10, 11, 12, 13)} == \
        {w[0]: w[2] for w in want if w[0] in (1, 2, 3, 10, 11, 12, 13)}


def test_query_against_all_pairs(spark, sf_small):
    fps = [(r.doc_id, brute_fingerprint(r.text))
           for r in read_table(spark, sf_small, "documents").collect()]
    component = brute_components(fps)
    want = sorted((i, f"{fp:016x}", component[i]) for i, fp in fps)
    assert rows(queries.op4_simhash(spark, sf_small)) == sorted(want, key=repr)


def test_hot_key_is_dealt_into_cells_without_losing_links(spark):
    """A cluster of many different fingerprints around one value, far over the
    size of a cell, and noise around it."""
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 260:
        fps.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    table = [(fp, i) for i, fp in enumerate(sorted(fps))]
    reps = spark.createDataFrame([(fp - 2**64 if fp >> 63 else fp, i) for fp, i in table],
                                 "fp long, node long")
    want = brute_components([(i, fp) for fp, i in table])
    for cell in (16, 1024):
        links = simhash.links(reps, cell=cell)
        assert simhash._hot_keys(reps, simhash.SEGMENTS, cell).count() > 0 or cell > 16
        found = {r.node: r.component for r in connected_components(links).collect()}
        assert {i: found.get(i, i) for _, i in table} == want


def test_sorted_groups_across_batches():
    fp = np.array([5, 4, 7, 900, 901], np.int64)
    columns = [np.array([1, 1, 1, 2, 2]), np.zeros(5, np.int64), np.array([True, False, True, True, True]),
               fp, np.arange(5)]
    whole = {(int(x), int(y)) for a, b in simhash._link_sorted([columns], 4) for x, y in zip(a, b)}
    split = [[c[i:i + 1] for c in columns] for i in range(5)]
    single = {(int(x), int(y)) for a, b in simhash._link_sorted(split, 4) for x, y in zip(a, b)}
    assert whole == single == {(1, 0), (2, 0), (4, 3)}


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 200)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.component for r in
             connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert found == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    component = {(i, t): c for (i, t), c in zip(
        [x for x in TEXTS if x[0] is not None],
        brute_rows([(i, brute_fingerprint(t)) for i, t in TEXTS if i is not None]))}
    named = [x for x in got if x[0] is not None]
    # one row of every component, under the doc_id that names it; texts sharing an id are two
    assert sorted(component[x] for x in named) == sorted(set(component.values()))
    assert all(component[x] == x[0] for x in named)
    assert len([x for x in got if x[0] is None]) == 1
    assert simhash.keep_one(docs.limit(0)).count() == 0


def brute_rows(fps):
    """The component of each row, rows linked by their fingerprints."""
    by_fp = {}
    for i, fp in fps:
        by_fp[fp] = min(by_fp.get(fp, i), i)
    component = brute_components([(k, fp) for k, fp in enumerate(by_fp)])
    name = {}
    for k, fp in enumerate(by_fp):
        name[component[k]] = min(name.get(component[k], by_fp[fp]), by_fp[fp])
    at = {fp: name[component[k]] for k, fp in enumerate(by_fp)}
    return [at[fp] for _, fp in fps]


def test_keep_one_with_repeated_ids(spark):
    """(4, a) (5, a) (5, b): the copy under 5 goes, the other text under 5 stays."""
    a, b = ("a text of its own " * 9, "something unrelated to it altogether, " * 9)
    rows_ = [(4, a), (5, a), (5, b), (5, b), (6, b + "x"), (None, b), (None, "no id " * 9),
             (None, "no id " * 9)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    kept = sorted(map(tuple, simhash.keep_one(docs).collect()), key=repr)
    want = [(4, a), (5, b), (None, "no id " * 9)]
    near = brute_components([(0, brute_fingerprint(b)), (1, brute_fingerprint(b + "x"))])[1] == 0
    assert kept == sorted(want + ([] if near else [(6, b + "x")]), key=repr)
