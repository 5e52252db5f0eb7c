import random

import pytest

from demand_engine.llm import decontaminate, queries
from demand_engine.llm.common import read_table
from demand_engine.llm.decontaminate import words_of

from .helpers import documents


def brute_tiles(a, b, k):
    """Greedy string tiling by looking at every pair of places, every round."""
    used_a, used_b, tiles = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while (i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]
                       and i + n not in used_a and j + n not in used_b):
                    n += 1
                if n >= k and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return tiles
        n, i, j = -best[0], best[1], best[2]
        tiles.append((i, j, n))
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))


@pytest.mark.parametrize("seed", range(40))
def test_tiles_as_by_brute_force(seed):
    rng = random.Random(seed)
    letters = "abcdefgh"[:rng.randint(3, 8)]
    item = [rng.choice(letters) for _ in range(rng.randint(3, 25))]
    doc = [rng.choice(letters) for _ in range(rng.randint(0, 30))] + item[rng.randint(0, 5):] + \
        [rng.choice(letters) for _ in range(rng.randint(0, 10))] + item[:rng.randint(3, 12)]
    table = decontaminate.SeedTable([(1, " ".join(item))], 3)
    _, found = table.matches(" ".join(doc))
    tiles = decontaminate.tile(*found[0], 3) if 0 in found else []
    assert sorted(tiles) == sorted(brute_tiles(doc, item, 3))


def brute_leaks(docs, items, k=5, threshold=0.8):
    """(doc_id, item_id, covered) with tiling by brute force on candidate pairs."""
    out = []
    for d, text in docs:
        words = words_of(text)
        runs = {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}
        for b, item in items:
            goal = words_of(item)
            if not any(tuple(goal[i:i + k]) in runs for i in range(len(goal) - k + 1)):
                continue
            places = [p for p in range(len(words)) if words[p] in goal]
            low, high = min(places), max(places) + 1
            covered = sum(n for *_, n in brute_tiles(words[low:high], goal, k)) \
                if high - low < 400 else None
            if covered is None or covered >= threshold * len(goal):
                out.append((d, b, covered))
    return out


def test_query_on_the_whole_table(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in read_table(spark, sf_small, "documents").collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, sf_small, "benchmark").collect()]
    got = {(r.doc_id, r.item_id): r.covered for r in queries.op10_decontamination(spark, sf_small)
           .collect()}
    literal = {(d, b) for d, t in docs for b, item in items if item in t}
    assert literal and literal <= set(got)
    for d, b, covered in brute_leaks(docs, items):
        assert covered is None or got.get((d, b)) == covered
    # nothing else is reported: every pair shares most words of the item in runs of five
    text, item = dict(docs), dict(items)
    for d, b in got:
        words, goal = words_of(text[d]), words_of(item[b])
        runs = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
        hit = {q + j for q in range(len(goal) - 4) if tuple(goal[q:q + 5]) in runs for j in range(5)}
        assert len(hit) >= 0.8 * len(goal)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr(
        "*", "'clash' AS doc_id", "'clash' AS tiles")


ITEM = [f"q{i}" for i in range(40)]


def test_reordered_partial_and_repeated_passages(spark):
    parts = [ITEM[30:], ITEM[20:30], ITEM[10:20], ITEM[:10]]
    texts = [(1, " foo ".join(" ".join(p) for p in parts)),              # reordered
             (2, " ".join(ITEM[:10] * 4)),                                 # one part, four times
             (3, "x " + ", ".join(w.upper() for w in ITEM) + ". y"),       # case and punctuation
             (4, " ".join(ITEM[:20])), (5, None), (6, ""), (None, " ".join(ITEM)),
             (3, "x " + ", ".join(w.upper() for w in ITEM) + ". y")]
    docs = documents(spark, texts)
    items = [(7, " ".join(ITEM)), (8, None), (9, ""), (10, "q0 q1 q2"), (None, " ".join(ITEM[:8]))]
    got = sorted(((r.doc_id, r.item_id, r.covered) for r in
                  decontaminate.leaks(docs, bench(spark, items)).collect()), key=repr)
    want = [(1, 7, 40), (3, 7, 40), (3, 7, 40), (None, 7, 40)] + \
        [(i, None, 8) for i in (1, 2, 3, 3, 4, None)]
    assert got == sorted(want, key=repr)
    kept = decontaminate.clean(docs, bench(spark, items[:4]))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6]


def test_blocks_of_the_test_set_give_the_same(spark, sf_small):
    docs = read_table(spark, sf_small, "documents")
    items = read_table(spark, sf_small, "benchmark")
    pairs = lambda df: sorted((r.doc_id, r.item_id, r.covered) for r in df.collect())
    assert pairs(decontaminate.leaks(docs, items, block_words=600)) == \
        pairs(decontaminate.leaks(docs, items))


def test_empty_tables(spark):
    docs, items = documents(spark), bench(spark, [(1, " ".join(ITEM))])
    assert decontaminate.leaks(docs.limit(0), items).collect() == []
    assert decontaminate.leaks(docs, items.limit(0)).collect() == []
    assert decontaminate.clean(docs, items.limit(0)).count() == docs.count()


def test_short_items_are_found_where_a_sentence_is_the_item(spark):
    docs = documents(spark, [(1, "Well. Forty two!\nend"), (2, "it is forty two here"), (3, "FORTY,  two"),
                             (4, None), (5, "yes; no yes")])
    items = bench(spark, [(1, "forty two"), (1, "forty two"), (2, "Yes"), (3, "..."), (None, "no yes")])
    got = sorted(((r.doc_id, r.item_id, r.covered, r.tiles[0].doc_start) for r in
                  decontaminate.leaks(docs, items).collect()), key=repr)
    assert got == sorted([(1, 1, 2, 1), (1, 1, 2, 1), (3, 1, 2, 0), (3, 1, 2, 0), (5, 2, 1, 0),
                          (5, None, 2, 1)], key=repr)
    assert [r.doc_id for r in decontaminate.clean(docs, items).select("doc_id").collect()] == [2, 4]


def test_blocks_are_bounded_in_every_script(spark):
    items = [(i, " ".join(f"語{i}の{j}" for j in range(50))) for i in range(40)]
    items += [(100, "w" * 9000), (101, "x " * 3000)] + [(7, "a b c d e f")] * 500
    shown = list(decontaminate._seed_tables(bench(spark, items), 5, 400))
    sizes = [sum(len(w) for w in s.value.words) for s in shown]
    assert sum(sizes) == 40 * 50 + 3000 + 6 and sorted(sizes)[-2] <= 400
    found = decontaminate.leaks(documents(spark, [(1, items[3][1] + " " + items[9][1])]),
                                bench(spark, items), block_words=400).collect()
    assert sorted(r.item_id for r in found) == [3, 9]


def test_common_openings_cost_linear_time(spark):
    """A text that repeats an opening 200 times against very many items with it."""
    import time
    opening = "the answer to this question"
    text = f"{opening} is " * 200
    def seconds(n):
        table = decontaminate.SeedTable(
            [(i, opening + "".join(f" w{i}x{j}" for j in range(20))) for i in range(n)], 5)
        start = time.process_time()
        assert not list(decontaminate._leaks_of(table, 1, text, 0.8))
        return time.process_time() - start
    seconds(100)
    assert seconds(16_000) < 0.5
