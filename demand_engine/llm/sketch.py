"""Document fingerprints: threshold-scaled sketches, built-in functions only.

The sketch of a text keeps every hash of a 5-word shingle that falls below a
fixed fraction of the hash range (and the smallest hash, so that no text with a
word has an empty sketch: a hash above the threshold is there only if it stands
alone). The threshold is the same for all texts, so sketches of parts merge
(``merge``: their union, of which hashes above the threshold go unless the least of
all is one) to the sketch of all their shingles, and overlaps of a short and a very
long text can be estimated in either direction: the shingles both keep are a fair sample of the
shingles both have.

``fingerprint`` is the sorted sketch, 16 hex digits a hash. Likeness is the
share of common hashes in the union of two sketches; containment the share of
one sketch that the other has.

Cases: null or empty text: empty fingerprint, likeness 1 to another empty one
and 0 to any other. Fewer than five words: one shingle of all words. The next
document is taken among distinct (doc_id, text) rows in descending doc_id, then
by text hash; repeated rows have the same result each. Rows without doc_id come
last in that order (the smallest long stands for the missing id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 4
_NO_ID = -(1 << 63)


def _bind(value: Column, fn) -> Column:
    """``fn`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _kept(h: Column, scale: int) -> Column:
    below = -(1 << 63) + (1 << 64) // scale
    least = F.filter(F.array(F.array_min(h)), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(F.filter(h, lambda x: x < F.lit(below)), least)))


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """The sketch of a text as a sorted array of hashes."""
    words = F.filter(F.split(text, r"[\s]+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - shingle),
                           lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]))
        one = F.transform(F.filter(F.array(h), lambda x: F.size(x) > 0), lambda x: F.xxhash64(x))
        return F.when(F.size(h) >= shingle, many).otherwise(one)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _bind(hashed, lambda h: _bind(shingles(h), lambda many: _kept(many, scale)))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the shingles of two parts from the parts' sketches."""
    return _bind(F.array_union(a, b), lambda h: _kept(h, scale))


def fingerprint(hashes: Column) -> Column:
    return F.lower(F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Share of ``a``'s sketch that ``b`` has (1 for an empty ``a``)."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"),
                       text.alias("text"), F.xxhash64(text).alias("k"))


def _previous(keyed: DataFrame) -> DataFrame:
    """For every distinct ``(id, k)`` the row before it in descending order (the
    last one for the first): ``(id, k, prev_id, prev_k, prev_half)``."""
    ids = materialize(
        keyed.select("id", "k", F.floor(F.length("text") / 2).cast("int").alias("half")).distinct()
        .orderBy(F.desc("id"), "k").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    whole = W.orderBy("part")  # one row per partition of the sort
    parts = (ids.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
             .withColumn("next", F.coalesce(F.lead("part").over(whole), F.min("part").over(
                 whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))))
    follows = (ids.withColumn("part", part).join(F.broadcast(parts), "part").select(
        F.col("id").alias("prev_id"), F.col("k").alias("prev_k"), F.col("half").alias("prev_half"),
        F.when(F.col("at") + 1 < F.shiftleft("part", 33) + F.col("n"), F.col("at") + 1)
        .otherwise(F.shiftleft("next", 33)).alias("at")))
    return follows.join(ids.select("id", "k", "at"), "at").drop("at")


def with_next(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``(doc_id, text, edited, sketch, edited_sketch, next_sketch)`` per row.

    ``edited`` is the text with its last half replaced by as many first
    characters of the next document."""
    keyed = _keyed(docs)
    # one of each set of repeated rows; not a ranked filter, which would change the
    # shuffle of the texts that the second join uses again
    again = F.lag("k").over(W.partitionBy("id", "k").orderBy("k"))
    ahead = (keyed.withColumn("again", again).filter("again IS NULL").join(_previous(keyed), ["id", "k"])
             .select(F.col("prev_id").alias("id"), F.col("prev_k").alias("k"),
                     F.substring(F.col("text"), F.lit(1), F.col("prev_half")).alias("head"),
                     sketch(F.col("text"), shingle, scale).alias("next_sketch")))
    stays = F.length("text") - F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), stays), F.col("head"))
    return (keyed.join(ahead, ["id", "k"], "left")
            .select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "text",
                    edited.alias("edited"), "next_sketch")
            .select("*", sketch(F.col("text"), shingle, scale).alias("sketch"),
                    sketch(F.col("edited"), shingle, scale).alias("edited_sketch")))
