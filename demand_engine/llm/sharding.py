"""Sharding by vector bin packing.

Rows with equal texts form a group with a size vector (bytes, tokens, rows).
Groups are packed into shards one after the other, largest first, each into the
shard where the dot product of its vector with the shard's residual capacity
(all scaled by the shard's fair share) is highest.

Scale. Packing is sequential, so what it packs is bounded whatever the input:
a group larger than ``1 / UNITS`` of a shard's share in any dimension is an item
of its own (there are at most 3 * UNITS * shards of those), all other groups are
dealt by their hash to ``UNITS * shards`` bundles, each an item. A group larger
than a whole shard cannot stay together: its rows are cut by the hash of their
doc_id into pieces of about half a shard's share. Rows that repeat both text and
doc_id (or have none) and are together larger than ``1 / UNITS`` of a share are cut,
and dealt to runs, by their number in the written table instead: they are
interchangeable, so which of them goes where depends on the files, the counts only
by chance. Item sizes are summed by Spark;
at most 4 * UNITS * shards rows plus the pieces reach the driver and go back as
the assignment table.

A last pass over the items evens out the bytes (law ``bytes``): sizes are near
equal, rows and tokens are balanced along, less strictly.

Cases: null text: no bytes, no tokens, crc32 of nothing (0), a group of its own
with the empty texts. Repeated rows and doc_ids are placed row by row. An empty
table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Items per shard that the small groups are bundled into.
UNITS = 256
#: Runs of rows that each shard's slots are numbered in.
RUNS = 64
ROW_BYTES = 16
_DIMENSIONS = ("bytes", "tokens", "rows")


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (``vectors``: items x dimensions, in shares of a shard)."""
    residual = np.ones((shards, vectors.shape[1]))
    shard = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-vectors.max(axis=1), kind="stable").tolist():
        v = vectors[i]
        best = int(np.argmax(residual @ v))
        shard[i] = best
        residual[best] -= v
    return _even_out(vectors[:, 0], shard, shards)


def _even_out(size: np.ndarray, shard: np.ndarray, shards: int, moves: int = 20_000) -> np.ndarray:
    """Move items from the fullest to the emptiest shard as long as that brings
    the two closer; the item whose size is nearest to half the gap goes."""
    held = [sorted(np.flatnonzero(shard == s).tolist(), key=lambda i: size[i])
            for s in range(shards)]
    load = np.bincount(shard, weights=size, minlength=shards)
    for _ in range(moves):
        full, empty = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[empty]
        at = bisect.bisect_left(held[full], gap / 2, key=lambda i: size[i])
        near = min((k for k in (at - 1, at) if 0 <= k < len(held[full])),
                   key=lambda k: abs(size[held[full][k]] - gap / 2), default=None)
        if near is None or not 0 < size[held[full][near]] < gap:
            break
        item = held[full].pop(near)
        bisect.insort(held[empty], item, key=lambda i: size[i])
        shard[item] = empty
        load[full] -= size[item]
        load[empty] += size[item]
    return shard


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       words.cast("long").alias("tokens"), F.xxhash64(text).alias("group"))


def shard_rows(docs: DataFrame, shards: int = 40, units: int = UNITS) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``, one row per row of ``docs``."""
    spark = docs.sparkSession
    rows = materialize(_measured(docs))
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"),
            F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, shard int, "
                                         "slot long")
    share = np.array([max(total[d], 1) / shards for d in _DIMENSIONS])
    largest = F.greatest(*[F.col(d) / float(s) for d, s in zip(_DIMENSIONS, share)])
    big = materialize(
        rows.groupBy("group").agg(*sums).filter(largest > 1 / units)  # <= 3 * units * shards
        .select("group", F.when(largest > 1, F.ceil(largest * 2)).otherwise(1).cast("long")
                .alias("pieces")))
    repeated = (rows.join(F.broadcast(big), "group").groupBy("group", "doc_id").agg(*sums)
                .filter((largest > 1 / units) & (F.col("rows") > 1))  # <= 3 * units * shards
                .select(F.col("group").alias("g"), F.col("doc_id").alias("d"),
                        F.lit(True).alias("again")))
    numbered = (rows.withColumn("at", F.monotonically_increasing_id())
                .join(F.broadcast(big), "group", "left")
                .join(F.broadcast(repeated), (F.col("group") == F.col("g"))
                      & F.col("doc_id").eqNullSafe(F.col("d")), "left")
                .withColumn("deal", F.when(F.col("again"), F.xxhash64("at"))))
    bundle = F.pmod(F.xxhash64(F.lit(3), F.col("group")), F.lit(units * shards))
    piece = F.pmod(F.coalesce("deal", F.xxhash64("doc_id")), F.col("pieces"))
    items = materialize(numbered.select(
        "doc_id", "size", "text_crc32", "tokens", "deal",
        F.when(F.col("pieces").isNull(), F.struct(bundle.alias("a"), F.lit(-1).cast("long").alias("b")))
        .otherwise(F.struct(F.col("group").alias("a"), piece.alias("b"))).alias("item")))
    sizes = items.groupBy("item").agg(*sums).orderBy("item").collect()
    shard = pack(np.array([[r[d] for d in _DIMENSIONS] for r in sizes]) / share, shards)
    plan = spark.createDataFrame([(tuple(r["item"]), int(s)) for r, s in zip(sizes, shard)],
                                 "item struct<a:long,b:long>, shard int")
    placed = items.join(F.broadcast(plan), "item").select(
        "doc_id", "size", "text_crc32", "shard",
        F.pmod(F.when(F.col("deal").isNotNull(), F.xxhash64(F.lit(5), "deal"))
               .otherwise(F.xxhash64("doc_id", "text_crc32")), F.lit(RUNS)).cast("int").alias("run"))
    placed = materialize(placed)
    before = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    slot = F.row_number().over(W.partitionBy("shard", "run").orderBy("doc_id", "text_crc32")) - 1
    return (placed.withColumn("at", slot)
            .join(F.broadcast(offsets), ["shard", "run"])  # shards * RUNS rows
            .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("at"))
                    .alias("slot")))
