"""Merkle manifest of a dataset with incrementally built witnesses.

Tree. The rows of a source, in doc_id order, are the leaves of its tree; every
``ARITY`` consecutive nodes (the last run may be shorter) become the hash of
their joined digests until one node is left. The sources' roots, in source
order, are the leaves of the tree above them.

Incremental witnesses. ``Appender`` takes nodes one after the other. It keeps one
open run per level; a node joining a run extends the partial witness of every
leaf under the run's earlier members and starts its own with theirs. A full run
is hashed and appended to the level above.

Distribution. Leaves are cut into aligned blocks of ``ARITY ** HEIGHT``
consecutive positions, so that a block is a whole subtree; blocks are appended
independently, each as a stream through one task. The block roots are the next
round's appends, in blocks of their own, until each tree has one node: two
rounds for 43 million leaves a source, three for 280 billion. A leaf's witness
is extended by the witness of its block's root (a join by block, at most
``ARITY ** HEIGHT`` rows a key) and by that of its source's root. A source holding
a third of all rows is so many blocks more. The trees of all sources grow at
once, and the tree over the sources is grown by the same code.

Positions come from a range-partitioned sort: rows are numbered inside their
partition, and each (partition, source) run is shifted by the source's rows in
earlier partitions. Texts are hashed where they lie; only digests are shuffled.

A witness is the digests of the siblings (32 bytes each), level by level, left to
right; with the position and the number of leaves of both trees it can be folded
back to the root (:func:`fold`).

Cases: null values are part of the leaf (``-``), an empty text is another leaf
than a null one. A null source is a source, first in order; rows without doc_id
come first in their source. Rows with equal doc_id are ordered by their leaf, so
repeated rows are interchangeable. One row alone: its leaf is the root and its
witness is empty. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_stream, materialize

ARITY = 3
#: Levels of a block: a block holds ARITY ** HEIGHT nodes.
HEIGHT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def join_hash(nodes) -> bytes:
    """The hash of digests, joined as hex text."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


class Appender:
    """The open runs of one block and the partial witnesses of its leaves."""

    def __init__(self, arity: int = ARITY):
        self.arity, self.open, self.witnesses = arity, [], []

    def append(self, node: bytes) -> None:
        self.witnesses.append(bytearray())
        self._join(0, node, len(self.witnesses) - 1)

    def _join(self, level: int, node: bytes, first: int) -> None:
        """``node`` covers the leaves from ``first`` to the newest."""
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        if run:
            earlier = b"".join(sibling for sibling, _ in run)
            for witness in self.witnesses[first:]:
                witness += earlier
            for witness in self.witnesses[run[0][1]:first]:
                witness += node
        run.append((node, first))
        if len(run) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._join(level + 1, join_hash(n for n, _ in run), run[0][1])

    def root(self, height: int | None = None) -> bytes:
        """Close what is open and return the root: of a subtree of ``height`` levels,
        or of a tree that ends with these leaves."""
        level = 0
        while True:
            run = self.open[level]
            above = any(self.open[level + 1:])
            if height == level or height is None and len(run) == 1 and not above:
                return run[0][0]
            if run:
                self._close(level)
            level += 1


def fold(node: bytes, witness: bytes, coordinates, arity: int = ARITY) -> bytes:
    """The root that ``node`` and its siblings give; ``coordinates`` are the
    (position, number of leaves) of the trees passed, lowest first."""
    at = 0
    for pos, n in coordinates:
        while n > 1:
            left = pos % arity
            others = min(arity, n - pos + left) - 1
            siblings = [witness[at + 32 * i:at + 32 * i + 32] for i in range(others)]
            at += 32 * others
            node = join_hash([*siblings[:left], node, *siblings[left:]])
            pos, n = pos // arity, -(-n // arity)
    return node


def serialized(values: list[Column]) -> Column:
    """``-`` for a null, else the value's UTF-8 byte count, ``:`` and the value."""
    parts = []
    for value in values:
        value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value),
                                F.lit("-")))
    return F.concat(*parts)


def leaf_hash(values: list[Column]) -> Column:
    return F.unhex(F.sha2(serialized(values).cast("binary"), 256))


def positions(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos`` and ``n``: each row's place in its ``tree`` by ``order``, and the
    tree's number of rows."""
    keys = ["tree", *order]
    ranged = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(ranged.withColumns({
        "part": F.spark_partition_id(), "k": F.monotonically_increasing_id()}))
    runs = placed.groupBy("tree", "part").agg(F.min("k").alias("first"),
                                              F.count(F.lit(1)).alias("here"))
    tree = W.partitionBy("tree").orderBy("part")  # a row per partition the tree reaches
    runs = runs.select(
        "tree", "part", "first",
        F.coalesce(F.sum("here").over(tree.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        .alias("earlier"), F.sum("here").over(W.partitionBy("tree")).alias("n"))
    return placed.join(runs, ["tree", "part"]).withColumn(
        "pos", F.col("k") - F.col("first") + F.col("earlier")).drop("part", "k", "first", "earlier")


def _append_blocks(nodes: DataFrame, height: int) -> DataFrame:
    """``(tree, pos, n, node)`` -> each node's block and its witness in the block;
    the first row of a block carries the block's root."""
    size = ARITY ** height
    dealt = nodes.select("tree", "pos", "n", "node",
                         F.floor(F.col("pos") / size).cast("long").alias("block"))
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")

    def run(batches):
        def closed(key, places, n, appender):
            root = appender.root(height if n > size else None)
            return ([key[0]] * len(places), places, [n] * len(places), [key[1]] * len(places),
                    [bytes(w) for w in appender.witnesses], [root] + [None] * (len(places) - 1))

        key = None
        for trees, places, ns, nodes_, blocks in batches:
            for tree, pos, n, node, block in zip(trees, places, ns, nodes_, blocks):
                if (tree, block) != key:
                    if key is not None:
                        yield closed(key, held, count, appender)
                    key, held, count, appender = (tree, block), [], n, Appender()
                appender.append(bytes(node))
                held.append(pos)
        if key is not None:
            yield closed(key, held, count, appender)

    return map_stream(dealt, run, "tree string, pos long, n long, block long, witness binary, "
                                  "root binary")


def grow(nodes: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """From ``(tree, pos, n, node)`` to ``roots(tree, root)`` and
    ``witnesses(tree, pos, n, witness)`` up to the root of each tree."""
    size, rounds = ARITY ** height, []
    while True:
        rounds.append(materialize(_append_blocks(nodes, height)))
        last = rounds[-1]
        if not last.agg(F.max("n")).first()[0] or last.filter(F.col("n") > size).isEmpty():
            break
        # a tree that is one block is done: its root is appended alone, without effect
        nodes = last.filter("root IS NOT NULL").select(
            "tree", F.col("block").alias("pos"),
            F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("root").alias("node"))
    roots = rounds[-1].filter("root IS NOT NULL").select("tree", "root")
    extended = rounds[-1].select("tree", "pos", "n", "witness")
    for lower in reversed(rounds[:-1]):
        later = extended.select("tree", F.col("pos").alias("block"), F.col("witness").alias("later"))
        extended = lower.join(later, ["tree", "block"]).select(
            "tree", "pos", "n", F.concat("witness", "later").alias("witness"))
    return roots, extended


def manifest(docs: DataFrame, also: dict[str, Column] | None = None,
             height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, leaf, subroot, root, witness, pos, n,
    source_pos, n_sources)``, digests and witness as bytes. ``also`` are further
    expressions of the rows to be carried along."""
    also = also or {}
    source = F.col("source").cast("string")
    leaves = docs.select(
        # null first, then bytewise: no other key starts below '='
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash([F.col(f) for f in FIELDS]).alias("node"),
        *[c.alias(name) for name, c in also.items()])
    placed = materialize(positions(materialize(leaves), ["doc_id", "node"]))
    subroots, witnesses = grow(placed.select("tree", "pos", "n", "node"), height)
    sources = positions(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"),
                                        F.col("root").alias("node")), ["source"])
    sources = materialize(sources.select("tree", "source", "node", "pos", "n"))
    top, above = grow(sources.select("tree", "pos", "n", "node"), height)
    upper = (sources.join(above.select("pos", F.col("witness").alias("above")), "pos")
             .join(top.select("tree", F.col("root")), "tree")
             .select(F.col("source").alias("tree"), F.col("node").alias("subroot"), "root", "above",
                     F.col("pos").alias("source_pos"), F.col("n").alias("n_sources")))
    whole = placed.join(witnesses.select("tree", "pos", "witness"), ["tree", "pos"])
    return whole.join(upper, "tree").select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root",
        F.concat("witness", "above").alias("witness"), "pos", "n", "source_pos", "n_sources",
        *also)


def refolded(rows: DataFrame, leaf: str) -> DataFrame:
    """Add ``folded``: the root that the digest in column ``leaf`` leads to."""
    names = [*rows.columns]
    at = [names.index(c) for c in (leaf, "witness", "pos", "n", "source_pos", "n_sources")]

    def run(batches):
        for columns in batches:
            folded = [fold(bytes(node), bytes(witness), ((pos, n), (spos, ns)))
                      for node, witness, pos, n, spos, ns in zip(*[columns[i] for i in at])]
            yield (*columns, folded)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_stream(rows, run, f"{schema}, folded binary")
