"""SimHash near-duplicates by multi-index hashing.

Fingerprint: every word shingle of a text votes with the 64 bits of its XXH64;
a bit is set if more than half of the shingles set it.

Search (distance at most ``r`` = 4): the 64 bits are cut into segments with
radii ``a_i`` such that ``sum(a_i) + number of segments = r + 1``; if every
segment differed by more than its radius the whole would differ by more than
``r``, so each linked pair agrees within the radius in at least one segment.
Here: 23 and 23 bits with radius 1, 18 bits with radius 0. A fingerprint sits
in the table of each segment under its own value and probes the small Hamming
ball around it (only towards larger values: the other direction is the other
fingerprint's probe); what meets under a key is verified on all 64 bits.

Hot keys: a key that many different fingerprints reach is dealt into blocks of
about ``CELL`` members and every pair of blocks meets in a cell of its own, so
no pair is lost and no task holds a whole key. Within a cell the verified pairs
are reduced to a spanning forest before they leave the task; equal fingerprints
are folded before the search. Components are taken on the forests.

Cases: null or empty text: fingerprint zero, linked like any other. Repeated
rows and doc_ids are judged row by row. A row without doc_id gets the component of
its fingerprint, or null if no row with a doc_id has that fingerprint.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, map_columns, map_stream, materialize, text_key
from .components import connected_components

#: (first bit, bits, radius) of each segment, for distance 4.
SEGMENTS = ((0, 23, 1), (23, 23, 1), (46, 18, 0))
#: Members of one block of a hot key.
CELL = 1024
#: Pairs compared at a time within a task.
PAIRS = 2_000_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def simhash(text: str, shingle: int = 4, seed: int = 42) -> int:
    """Signed 64-bit view of the fingerprint of one text."""
    words = text.encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(joined, seed)]
    else:
        after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *after[:len(words) - shingle].tolist()]
        hashes = [digest(joined[i:j], seed)
                  for i, j in zip(starts, (after[shingle - 1:] - 1).tolist())]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    histogram = np.bincount((octets + np.arange(0, 2048, 256)).reshape(-1), minlength=2048)
    counts = (histogram.reshape(8, 256) @ _BITS).reshape(64)
    set_bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, k1, k2, fp)`` per row; ``fp`` is the signed view of the 64 bits, ``k1``
    and ``k2`` stand for the text."""
    texts = doc_texts(docs).select("doc_id", "text", *text_key(F.col("text")))
    return map_columns(texts, lambda ids, texts, k1, k2: (
        ids, k1, k2, [simhash(t, shingle, seed) for t in texts]),
        "doc_id long, k1 long, k2 long, fp long")


def _segment(first: int, bits: int) -> str:
    return f"(shiftrightunsigned(fp, {first}) & {(1 << bits) - 1}L)"


def _entries(reps: DataFrame, segments) -> DataFrame:
    """``(key, own, fp, node)``: table entries and ball probes of each segment."""
    keys = []
    for k, (first, bits, radius) in enumerate(segments):
        value, high = _segment(first, bits), f"{k}L << 32"
        keys.append(f"array(named_struct('key', {value} + ({high}), 'own', true))")
        if radius == 1:
            keys.append(
                f"transform(filter(transform(sequence(0, {bits - 1}), j -> {value} ^ shiftleft(1L, j)), "
                f"z -> z > {value}), z -> named_struct('key', z + ({high}), 'own', false))")
        elif radius:
            raise ValueError("segments have radius 0 or 1")
    return (reps.select("fp", "node", F.explode(F.expr(f"concat({', '.join(keys)})")).alias("e"))
            .select("e.key", "e.own", "fp", "node"))


def _hot_keys(reps: DataFrame, segments, cell: int) -> DataFrame:
    """``(key, parts)`` of the keys that more than about ``cell`` members reach.
    A key gets members from its own value and from one value per bit, so it can
    be large only if one of those values has more than its share of ``cell``."""
    most = max(bits for _, bits, _ in segments) + 1
    values = F.expr("array(" + ", ".join(
        f"named_struct('k', {k}, 'v', {_segment(first, bits)})"
        for k, (first, bits, _) in enumerate(segments)) + ")")
    full = (reps.select(F.explode(values).alias("s")).groupBy("s.k", "s.v")
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell // most))
    reach = F.expr("CASE " + " ".join(
        f"WHEN k = {k} THEN concat(array(v), " + (
            f"transform(sequence(0, {bits - 1}), j -> v ^ shiftleft(1L, j))" if radius else
            "array()") + ")" for k, (_, bits, radius) in enumerate(segments)) + " END")
    return (full.select("k", "n", F.explode(reach).alias("z"))
            .groupBy((F.col("z") + F.shiftleft(F.col("k").cast("long"), 32)).alias("key"))
            .agg(F.ceil(F.sum("n") / cell + 1).cast("long").alias("parts")).filter("parts > 2"))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star forest ``(node, smallest node)`` that spans the links ``a - b``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _link_sorted(batches, distance: int):
    """Rows sorted by (key, cell): link every table entry with all it meets."""
    held = None
    for columns in batches:
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        key, cell = columns[:2]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
        held = [c[new[-1]:] for c in columns]  # the last group may go on
        yield from _link_groups([c[:new[-1]] for c in columns], new[:-1], distance)
    if held is not None:
        yield from _link_groups(held, np.zeros(1, np.int64), distance)


def _link_groups(columns, starts, distance: int):
    _, _, own, fp, node = columns
    if not len(starts):
        return
    sizes = np.diff(np.r_[starts, len(fp)])
    group = np.repeat(np.arange(len(starts)), sizes)
    entry = np.flatnonzero(own & (sizes[group] > 1))
    if not len(entry):
        return
    fp = fp.view(np.uint64)
    pairs = sizes[group[entry]]
    chunk = np.cumsum(pairs) // PAIRS
    for part in np.split(np.arange(len(entry)), np.flatnonzero(np.diff(chunk)) + 1):
        n = pairs[part]
        i = np.repeat(entry[part], n)
        j = np.repeat(starts[group[entry[part]]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near = np.flatnonzero((i != j) & (np.bitwise_count(fp[i] ^ fp[j]) <= distance))
        if len(near):
            yield _forest(node[i[near]], node[j[near]])


def links(reps: DataFrame, distance: int = 4, segments=SEGMENTS, cell: int = CELL) -> DataFrame:
    """Links ``(a, b)`` that span the components of ``reps(fp, node)`` at
    ``distance`` or fewer differing bits; ``fp`` is distinct."""
    if sum(radius for *_, radius in segments) + len(segments) != distance + 1:
        raise ValueError("the segments' radii do not add up for this distance")
    hot = materialize(_hot_keys(reps, segments, cell))  # its size decides how it is joined
    dealt = _entries(reps, segments).join(hot, "key", "left").withColumn(
        "block", F.pmod(F.xxhash64("fp"), F.col("parts")))
    cells = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.expr(
        "transform(sequence(0L, parts - 1), c -> least(block, c) * parts + greatest(block, c))"))
    met = (dealt.select("key", F.explode(cells).alias("cell"), "own", "fp", "node")
           .repartition("key", "cell").sortWithinPartitions("key", "cell"))
    return map_stream(met, lambda batches: _link_sorted(batches, distance), "a long, b long",
                      arrays=True)


def _components(fps: DataFrame, distance: int) -> DataFrame:
    """``(fp, component_id)`` of every fingerprint that a row with a doc_id has."""
    reps = materialize(fps.filter("doc_id IS NOT NULL").groupBy("fp")
                       .agg(F.min("doc_id").alias("node")))
    found = connected_components(links(reps, distance))
    return reps.join(found, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4,
                    seed: int = 42) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs``."""
    fps = materialize(fingerprints(docs, shingle, seed).select("doc_id", "fp"))
    return fps.join(_components(fps, distance), "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row, with the
    doc_id that names it. Rows are told apart by doc_id and text, so different
    documents under one doc_id are judged each by its own fingerprint; of several in
    one component the text with the smallest key stays, of repeated rows any one.
    Rows without doc_id go if a row with one has their fingerprint; else one row
    of each fingerprint stays."""
    fps = materialize(fingerprints(docs, shingle))
    judged = fps.join(_components(fps, distance), "fp", "left")
    stay = (judged.filter("doc_id = component_id OR component_id IS NULL")
            .groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp"))
            .agg(F.min(F.struct("k1", "k2")).alias("k"))
            .select(F.col("component_id").alias("__id"), F.col("k.k1").alias("__s1"),
                    F.col("k.k2").alias("__s2")))
    k1, k2 = text_key(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})
    kept = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__k1") == F.col("__s1"))
                      & (F.col("__k2") == F.col("__s2")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__k1", "__k2"]).select(*docs.columns)
