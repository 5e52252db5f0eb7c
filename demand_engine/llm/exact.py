"""Exact deduplication against a persistent digest index.

Index. A Parquet table, bucketed and sorted by the SHA-256 digest of the
normalised text (white space of ``[\\x20\\x09-\\x0D]`` deleted), one row per digest:
the document that stays for it and the batch that brought it. It outlives the
session: opened again by its path, it keeps its buckets.

Adding a batch. The batch is reduced to one row per digest by a partial
aggregate (a group of copies ships one row per task), dealt to the index's
buckets, and deduplicated by a sort-merge anti-join, for which the index is
read as it lies (no shuffle of the index, whatever its size). The digests left
are appended, one file per bucket, in one committed write: a failed append
leaves nothing behind, and a batch name that the index already holds is not
added again, so a batch may be repeated after a failure.

Which row stays: the one indexed first; within a batch the row with the most
code points, then the smallest doc_id. ``deduplicate`` adds a table in batches of
falling text length, so that over the whole table the longest row stays.

Skew. Rows find their answer by a join on the digest. Groups of more than
``1 / (4 * buckets)`` of all rows (at most ``4 * buckets`` of them) are looked up
in a broadcast table instead, so no group of copies meets in one task.

Cases: null text counts as empty; null, empty and white-space-only texts are one
group. A row without doc_id comes after every row with one. Of repeated rows
exactly one stays. Very long texts are hashed where they lie; only digests are
written and shuffled. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, work_dir

#: Batches of falling text length in which a table is added.
BATCHES = 4
WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "digest binary, keep_id long, n_points int, row long, batch string"


class DigestIndex:
    """A bucketed, sorted Parquet table of digests under ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"digest_index_{hashlib.md5(path.encode()).hexdigest()}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({SCHEMA}) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
                  f"LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows in the partitions of the index's buckets."""
        return rows.repartition(self.buckets, "digest")

    def holds(self, batch: str) -> bool:
        return not self.read().filter(F.col("batch") == batch).isEmpty()

    def add(self, rows: DataFrame, batch: str) -> None:
        """Append the digests of ``rows`` (see :func:`digests`) not yet held."""
        if self.holds(batch):
            return
        first = rows.groupBy("digest").agg(F.min(F.struct(
            (-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"),
            "doc_id", "row")).alias("first"))
        new = self.dealt(first).join(self.read().select("digest").hint("merge"), "digest",
                                     "left_anti")
        (new.select("digest", F.col("first.doc_id").alias("keep_id"),
                    (-F.col("first.n")).alias("n_points"), "first.row",
                    F.lit(batch).alias("batch"))
         .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", self.path).saveAsTable(self.table))

    def answers(self, rows: DataFrame) -> DataFrame:
        """What the index says of every digest in ``rows``:
        ``(digest, keep_id, row, batch, group_size)``."""
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        held = self.read().select("digest", "keep_id", F.col("row").alias("keep_row"),
                                  F.col("batch").alias("keep_batch"))
        return self.dealt(sizes).join(held.hint("merge"), "digest")


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, n_points, row)``, written once; ``row`` numbers the rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    normal = F.translate(text, WHITE, "")
    return materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"),
        F.length(text).alias("n_points"), F.monotonically_increasing_id().alias("row")))


def decisions(rows: DataFrame, index: DigestIndex, batch_of) -> DataFrame:
    """Every row with the row that stays for its digest; ``batch_of`` is the name
    of each row's own batch (a row of an earlier batch is never this one)."""
    answers = materialize(index.answers(rows))
    n = rows.count()
    hot = answers.filter(F.col("group_size") * (4 * index.buckets) > n)  # <= 4 * buckets rows
    common = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    found = rows.join(F.broadcast(hot), "digest").unionByName(
        index.dealt(common).join(answers.join(F.broadcast(hot.select("digest")), "digest",
                                              "left_anti"), "digest"))
    kept = (F.col("keep_batch") == batch_of) & (F.col("keep_row") == F.col("row"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batches: int = BATCHES,
                name: str | None = None) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, digest)``, one row per row of ``docs``.

    With a given ``index``, texts it already holds are dropped in favour of the
    row that brought them (its ``keep_id``); ``group_size`` counts rows of ``docs``.
    """
    spark = docs.sparkSession
    name = name or uuid.uuid4().hex
    index = index or DigestIndex(spark, f"{work_dir(spark)}/digest-index-{name}")
    rows = digests(docs)
    cuts = rows.agg(F.percentile_approx(
        "n_points", [1 - k / batches for k in range(1, batches)], 1000)).first()[0] or []
    number = F.lit(0)  # 0: the longest texts
    for cut in cuts:
        number = number + (F.col("n_points") < cut).cast("int")
    batch_of = F.concat(F.lit(f"{name}/"), number.cast("string"))
    for k in range(len(cuts) + 1):
        index.add(rows.filter(number == k), f"{name}/{k}")
    return decisions(rows, index, batch_of)
