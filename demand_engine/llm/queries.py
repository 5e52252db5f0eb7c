"""The registered ``opN_<name>`` queries: each applies its operator, with
production parameters, to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (align, bpe, decontaminate, exact, langid, merkle, pii, secrets, sharding, simhash,
               sketch, substring, toxicity)
from .common import fold_of, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def bpe_digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(read_table(spark, sf_dir, "documents"))


@register
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


@register
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op8_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS pos, ws FROM words WHERE len(ws) >= 50),
hashed AS (
  SELECT doc_id, pos, md5(array_to_string(ws[pos:pos + 49], ' ')) AS h FROM windows),
repeated AS (
  SELECT doc_id, pos FROM hashed
  QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT doc_id, unnest(range(pos, pos + 50)) AS p FROM repeated) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda w, i: NOT list_contains(coalesce(ps, []), i)), ' '))
         AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""


@register
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(read_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


@register
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"),
                               read_table(spark, sf_dir, "benchmark"))


@register
def op7_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sketch.with_next(read_table(spark, sf_dir, "documents"))
    return s.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch.fingerprint(F.col("sketch")).alias("fingerprint"),
        sketch.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketch.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketch.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        sketch.containment(F.col("sketch"), F.col("next_sketch")).alias("contained_in_next"))


@register
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxic_scores(read_table(spark, sf_dir, "documents"),
                                   read_table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@register
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = pii.find_all(docs, pii.fit(docs))
    return found.select(
        "doc_id", *[F.regexp_count("base", F.lit(f"(^|,){kind}:")).cast("long").alias(f"n_{kind}")
                    for kind in pii.BASE_KINDS],
        F.sha2("base", 256).alias("base_sha256"), "spans")


@register
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.languages(docs, langid.fit(docs))
    return found.select("doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "lang_pred",
                        "score")


@register
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = secrets.find_all(docs, secrets.fit(docs))
    return found.select(
        "doc_id", *[F.regexp_count("base", F.lit(f"(^|,){kind}:")).cast("long").alias(f"n_{kind}")
                    for kind in secrets.BASE_KINDS],
        F.sha2("base", 256).alias("base_sha256"), "spans")


@register
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.deduplicate(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept",
                        F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL["op11_exact_dedup"] = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER longest AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER longest = 1 AS kept, sha256(t) AS text_sha256
FROM normal WINDOW longest AS (PARTITION BY t ORDER BY n_points DESC, doc_id)
"""


@register
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return align.linked_counts(read_table(spark, sf_dir, "documents"),
                               public_tokenizers.path("byte_bpe_50k.json"),
                               public_tokenizers.path("piece_bpe_32k.model"),
                               public_tokenizers.PATTERN)


@register
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    changed = [F.translate("text", "\n", "") if f == "text" else F.col(f) for f in merkle.FIELDS]
    hit = fold_of(F.col("doc_id"), 2) == 0
    rows = merkle.manifest(docs, {"tampered": F.when(hit, merkle.leaf_hash(changed))})
    rows = merkle.refolded(rows.withColumn("met", F.coalesce("tampered", "leaf")), "met")
    return rows.select(
        "doc_id", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(F.lower(F.hex("witness")).cast("binary"), 256).alias("proof_sha256"),
        F.lower(F.hex("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))


ORACLE_SQL["op13_merkle_manifest"] = r"""
WITH RECURSIVE field AS (
  SELECT doc_id, source, text, CAST(doc_id AS VARCHAR) AS a, source AS b, lang AS c,
         CAST(n_chars AS VARCHAR) AS d FROM documents),
leaf AS (
  SELECT doc_id, source, concat(
           coalesce(strlen(a) || ':' || a, '-'), coalesce(strlen(b) || ':' || b, '-'),
           coalesce(strlen(c) || ':' || c, '-'), coalesce(strlen(d) || ':' || d, '-')) AS head,
         text, replace(text, chr(10), '') AS changed FROM field),
hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS tampered,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
         -- CRC-32, bit by bit; its complement is even where the register is odd
         list_reduce(list_concat([4294967295], list_transform(
             str_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) & 1 = 1
           AS even
  FROM leaf),
level AS (
  SELECT source, 0 AS lvl, list(leaf ORDER BY pos) AS nodes FROM hashed GROUP BY source
  UNION ALL
  SELECT source, lvl + 1, list_transform(range(1, len(nodes) + 1, 3),
           lambda i: sha256(array_to_string(nodes[i:i + 2], '')))
  FROM level WHERE len(nodes) > 1),
top AS (
  SELECT source, nodes[1] AS subroot,
         row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS spos
  FROM level WHERE len(nodes) = 1),
above AS (
  SELECT 0 AS lvl, list(subroot ORDER BY spos) AS nodes FROM top
  UNION ALL
  SELECT lvl + 1, list_transform(range(1, len(nodes) + 1, 3),
           lambda i: sha256(array_to_string(nodes[i:i + 2], '')))
  FROM above WHERE len(nodes) > 1),
height AS (SELECT source, max(lvl) AS h FROM level GROUP BY source),
step AS (
  SELECT source, lvl, nodes FROM level WHERE len(nodes) > 1
  UNION ALL
  SELECT h.source, h.h + above.lvl, above.nodes FROM above, height h WHERE len(above.nodes) > 1),
walk AS (
  SELECT doc_id, hashed.source, 0 AS lvl, pos, spos, h, '' AS proof,
         CASE WHEN even THEN tampered ELSE leaf END AS node
  FROM hashed JOIN top ON hashed.source IS NOT DISTINCT FROM top.source
  JOIN height ON hashed.source IS NOT DISTINCT FROM height.source
  UNION ALL
  SELECT doc_id, w.source, w.lvl + 1, CASE WHEN w.lvl + 1 = h THEN spos ELSE pos // 3 END, spos, h,
         proof || array_to_string(list_filter(nodes[pos // 3 * 3 + 1:pos // 3 * 3 + 3],
                                              lambda x, i: i <> pos % 3 + 1), ''),
         sha256(array_to_string(list_transform(nodes[pos // 3 * 3 + 1:pos // 3 * 3 + 3],
                                               lambda x, i: CASE WHEN i = pos % 3 + 1 THEN node
                                                                 ELSE x END), ''))
  FROM (SELECT * REPLACE (CASE WHEN lvl = 0 AND h = 0 THEN spos ELSE pos END AS pos) FROM walk) w
  JOIN step s ON w.source IS NOT DISTINCT FROM s.source AND w.lvl = s.lvl)
SELECT w.doc_id, leaf, subroot, nodes[1] AS root, sha256(proof) AS proof_sha256,
       node AS folded_root, node = nodes[1] AS verified
FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1) w
JOIN hashed USING (doc_id) JOIN top ON hashed.source IS NOT DISTINCT FROM top.source
JOIN above ON len(above.nodes) = 1
"""
