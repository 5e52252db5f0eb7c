import hashlib
import re

from demand_engine.llm import exact, queries
from demand_engine.llm.common import read_table

from .helpers import CLASHES, TEXTS, documents, rows


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(texts):
    """(doc_id, keep_id, group_size, kept) of every row, as a sorted list."""
    groups = {}
    for i, t in texts:
        groups.setdefault(normal(t), []).append((i, t))
    out = []
    for members in groups.values():
        members.sort(key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))
        out += [(i, members[0][0], len(members), k == 0) for k, (i, _) in enumerate(members)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=repr)


TIES = [(31, "x y"), (30, "xy "), (32, "x\ty"), (33, "xy"), (34, "XY"), (35, "x y"),
        (36, "x\x1cy"), (None, "x  y "), (None, "only row without id"), (None, "only row without id")]


def test_awkward_documents(spark):
    assert found(exact.deduplicate(documents(spark, TEXTS + TIES))) == brute(TEXTS + TIES)
    assert set(CLASHES) - {"kept", "digest"} == set(CLASHES)


def test_any_number_of_batches_gives_the_same(spark):
    texts = TEXTS + TIES
    for batches in (1, 2, 7):
        assert found(exact.deduplicate(documents(spark, texts), batches=batches)) == brute(texts)


def test_empty_table(spark):
    assert exact.deduplicate(documents(spark).limit(0)).collect() == []


def test_hot_groups(spark):
    texts = [(i, "copied  text" + " " * (i % 5)) for i in range(2000)] + \
        [(5000 + i, f"own text {i // 2}") for i in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert found(exact.deduplicate(docs)) == brute(texts)


def test_the_index_outlives_a_batch_and_a_session(spark, tmp_path):
    path = str(tmp_path / "index")
    first = [(1, "seen before"), (2, "other")]
    second = [(3, "seen   before "), (4, "new"), (5, "n e w"), (6, None)]
    exact.deduplicate(documents(spark, first), exact.DigestIndex(spark, path, 4), name="a")
    spark.sql(f"DROP TABLE {exact.DigestIndex(spark, path, 4).table}")  # the files stay
    index = exact.DigestIndex(spark, path, 4)
    assert index.read().count() == 2
    want = [(3, 1, 1, False), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True)]
    assert found(exact.deduplicate(documents(spark, second), index, name="b")) == want
    assert index.read().count() == 4
    # a batch that is added again (after a failure, say) leaves the index as it was
    again = exact.deduplicate(documents(spark, second), index, name="b")
    assert found(again) == want and index.read().count() == 4


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "index"), 4)
    docs = exact.digests(documents(spark))
    index.add(docs, "a")
    plan = index.answers(docs)._jdf.queryExecution().executedPlan().toString()
    index_side = plan[plan.rindex("SortMergeJoin"):]
    assert "Bucketed: true" in plan and index_side.count("REPARTITION_BY_NUM") == 1


def test_query_on_the_whole_table(spark, sf_small):
    texts = [(r.doc_id, r.text) for r in read_table(spark, sf_small, "documents").collect()]
    out = queries.op11_exact_dedup(spark, sf_small)
    assert found(out) == brute(texts)
    assert sorted((r.doc_id, r.text_sha256) for r in out.collect()) == sorted(
        (i, hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in texts)
    assert rows(out)
