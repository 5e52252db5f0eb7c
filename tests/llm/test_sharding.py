import zlib

import numpy as np

from demand_engine.llm import queries, sharding
from demand_engine.llm.common import read_table

from .helpers import TEXTS, documents


def check(out, texts, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == \
        sorted((i is None, i or 0) for i, _ in texts)
    for s in range(shards):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in texts)
    assert sorted((r.size, r.text_crc32) for r in out) == sizes


def test_awkward_documents(spark):
    out = sharding.shard_rows(documents(spark), shards=4).collect()
    check(out, TEXTS, 4)
    assert sharding.shard_rows(documents(spark).limit(0), shards=4).collect() == []


def test_whole_table_is_even_and_keeps_groups(spark, sf_medium):
    texts = [(r.doc_id, r.text) for r in read_table(spark, sf_medium, "documents").collect()]
    out = queries.op9_sharding(spark, sf_medium).collect()
    check(out, texts, 40)
    load = np.zeros(40)
    for r in out:
        load[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert load.max() / load.min() < 1.02
    text = dict(texts)
    shards_of = {}
    for r in out:
        shards_of.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in shards_of.values())


def test_a_group_larger_than_a_shard_is_cut_evenly(spark):
    texts = [(i, "copied text " * 20) for i in range(3000)] + [(5000 + i, f"own text {i} " * 20)
                                                                for i in range(6000)]
    out = sharding.shard_rows(spark.createDataFrame(texts, "doc_id long, text string"), 10).collect()
    check(out, texts, 10)
    load = np.zeros(10)
    for r in out:
        load[r.shard] += r.size
    assert load.max() / load.min() < 1.02


def test_repeated_rows_and_copies_without_doc_id_are_cut_evenly(spark):
    for doc_id in (7, None):
        texts = [(doc_id, "copied text " * 20)] * 3000 + [(5000 + i, f"own text {i} " * 20)
                                                          for i in range(6000)]
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
        out = sharding.shard_rows(docs, 10).collect()
        check(out, texts, 10)
        load = np.bincount([r.shard for r in out], weights=[r.size for r in out], minlength=10)
        assert load.max() / load.min() < 1.02


def test_pack_prefers_room_in_the_scarce_dimension():
    shard = sharding.pack(np.array([[0.9, 0.1], [0.1, 0.9], [0.1, 0.85], [0.85, 0.1]]), 2)
    assert shard[0] != shard[3] or shard[1] != shard[2]


def test_packing_as_by_brute_force(monkeypatch):
    """Each item, largest first, goes where its dot product with what is left is
    highest, by plain arithmetic on every shard."""
    monkeypatch.setattr(sharding, "_even_out", lambda size, shard, shards: shard)
    rng = np.random.default_rng(5)
    for trial in range(30):
        n, shards = int(rng.integers(1, 60)), int(rng.integers(1, 7))
        vectors = rng.integers(1, 1 << 10, (n, 3)) / (1 << 13)  # exact in binary, so ties are ties
        left = [[1.0] * 3 for _ in range(shards)]
        want = [0] * n
        for i in sorted(range(n), key=lambda i: (-max(vectors[i]), i)):
            room = [sum(v * r for v, r in zip(vectors[i].tolist(), held)) for held in left]
            want[i] = room.index(max(room))
            left[want[i]] = [r - v for v, r in zip(vectors[i].tolist(), left[want[i]])]
        assert sharding.pack(vectors, shards).tolist() == want


def test_evening_out_never_widens_the_gap():
    rng = np.random.default_rng(6)
    for shards in (2, 5, 40):
        size = rng.pareto(1.5, 2000) + 0.01
        before = rng.integers(0, shards, 2000)
        load = np.bincount(before, weights=size, minlength=shards)
        after = sharding._even_out(size, before.copy(), shards)
        moved = np.bincount(after, weights=size, minlength=shards)
        assert np.ptp(moved) <= np.ptp(load) and np.isclose(moved.sum(), size.sum())
        assert np.ptp(moved) < max(0.02 * moved.mean(), np.sort(size)[0]) or moved.max() == size.max()
