import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from demand_engine.llm import merkle, queries
from demand_engine.llm.common import read_table

from .helpers import documents


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root and, for every leaf, the siblings from bottom to top."""
    proofs, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for j in run:
                for x in spans[j]:
                    proofs[x] += [nodes[k] for k in run if k != j]
        nodes, spans = ([sha("".join(nodes[k] for k in run)) for run in runs],
                        [[x for k in run for x in spans[k]] for run in runs])
    return nodes[0], proofs


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0,
                                                   leaf(r, r.text), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources}
    root, above = tree([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        members = sorted(by_source[s], key=lambda x: x[:3])
        for (_, _, own, r), proof in zip(members, trees[s][1]):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            same = not hit or r.text is None or "\n" not in r.text
            out.append((r.doc_id, own, trees[s][0], root, sha("".join(proof + above[k])), same))
    return sorted(out, key=repr)


def found(df):
    got = df.collect()
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified)
                   for r in got), key=repr)


def table(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_awkward_documents(spark, tmp_path):
    docs = documents(spark).withColumns({
        "source": F.expr("CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' "
                         "WHEN doc_id % 4 = 2 THEN 'ü' ELSE 'z' END"),
        "lang": F.expr("nullif(doc_id, 7)").cast("string"),
        "n_chars": F.expr("nullif(n_chars, 0)")})
    sf = table(spark, tmp_path, docs)
    assert found(queries.op13_merkle_manifest(spark, sf)) == brute(docs.collect())


def test_empty_table_and_one_row(spark, tmp_path):
    sf = table(spark, tmp_path / "a", documents(spark).limit(0))
    assert queries.op13_merkle_manifest(spark, sf).collect() == []
    one = documents(spark, [(4, "one")])
    got = queries.op13_merkle_manifest(spark, table(spark, tmp_path / "b", one)).first()
    assert got.leaf == got.subroot == got.root == got.folded_root and got.proof_sha256 == sha("")


def test_query_on_the_whole_table(spark, sf_small):
    assert found(queries.op13_merkle_manifest(spark, sf_small)) == \
        brute(read_table(spark, sf_small, "documents").collect())


@pytest.mark.parametrize("height", [1, 2, 3])
def test_blocks_of_any_height_give_the_same_trees(spark, height):
    rng = random.Random(height)
    texts = [(i, "s" * rng.choice([0, 1, 2, 60])) for i in range(100)] + [(7, "again")] * 3
    docs = spark.createDataFrame([(i, t, None if len(t) == 60 else t[:1], "en", len(t))
                                  for i, t in texts],
                                 "doc_id long, text string, source string, lang string, n_chars long"
                                 ).repartition(3)
    got = sorted(((r.doc_id, bytes(r.leaf).hex(), bytes(r.subroot).hex(), bytes(r.root).hex(),
                   sha(bytes(r.witness).hex())) for r in merkle.manifest(docs, height=height).collect()),
                 key=repr)
    assert got == sorted((x[:5] for x in brute(docs.collect())), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 82])
def test_appended_witnesses_fold_to_the_root(n):
    nodes = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    appender = merkle.Appender()
    for node in nodes:
        appender.append(node)
    root = appender.root()
    assert root.hex() == tree([x.hex() for x in nodes])[0]
    for i, node in enumerate(nodes):
        witness = bytes(appender.witnesses[i])
        assert merkle.fold(node, witness, [(i, n)]) == root
        assert n == 1 or merkle.fold(nodes[i - 1], witness, [(i, n)]) != root
