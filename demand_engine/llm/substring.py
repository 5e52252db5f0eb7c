"""Substring deduplication by relative Lempel-Ziv parsing against an index.

Reference index. The windows of ``window`` words of every text are indexed by
their minimizer: the smallest hash among the seeds (``seed_words`` words) inside
the window. Equal windows have equal minimizers, so a window can occur in a
second text only if its minimizer does; minimizers are few (about two for every
``window - seed_words + 2`` words), and only windows whose minimizer is shared
by two texts enter the index. The index blocks are hash partitions of the
window phrases; each phrase names its earliest place (smallest doc_id, then
position).

Parse. A text looks up its phrases in every block that can hold them. The places
it finds fall into stretches of consecutive windows; the references of a stretch
are the documents that hold the earliest place of one of its windows, each as far
to both sides of such places as the stretch goes. A stretch is factored greedily
from left to right: a factor is the longest match of what follows in any of these
(ties: smallest doc_id). Equal windows have
the same earliest place, so a reference is compared as its own sequence of earliest
places, which the parse of the reference already knows in runs; only the runs
near a match are fetched. Where a factor ends, the boundary is checked: the next
factor starts at the first window that the factor does not hold, so it may share up
to ``window - 1`` words with it. A factor of at least ``window`` words whose
reference has a smaller doc_id is a duplicate span, and the words of all spans are
removed.

Equal texts are folded first: a copy is one factor over its whole length. The
seeds and phrases of a passage that very many texts share, and a reference that very
many texts ask for, are dealt into cells for their look-up, so they do not meet in
one task.
Hashes of windows have 64 bits, text keys 128.

Cases: null or empty text: no words, nothing removed. A row without doc_id is
neither a reference nor changed. Rows with the same doc_id and different texts
are parsed separately and never serve as each other's reference. Repeated rows
are kept row by row. A text shorter than the window is never changed.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import doc_texts, map_stream, materialize, text_key

WINDOW = 50
SEED_WORDS = 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and ``base ** -i`` (mod 2**64) for i < n, grown on demand."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 2 * len(_powers[k])), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().split()  # bytes split at ASCII white space only
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, from running sums."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up)])
    return _mix((sums[k:] - sums[:n - k + 1]) * down[:n - k + 1])


def minimizers(words: np.ndarray, window: int, seed_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The seed hashes, and for every window the position of its minimizer."""
    seeds = run_hashes(words, seed_words)
    span = window - seed_words + 1
    if len(words) < window:
        return seeds, np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(seeds, span)
    return seeds, np.arange(len(views)) + views.argmin(axis=1)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _anchors(docs: DataFrame, window: int, seed_words: int) -> DataFrame:
    """Minimizer seeds of each row: ``(doc_id, k1, k2, seeds, at)``, no text."""
    def run(batches):
        for ids, texts, k1, k2 in batches:
            seeds, places = [], []
            for text in texts:
                found, at = minimizers(word_hashes(text), window, seed_words)
                at = np.unique(at)
                places.append(at.astype(np.int32))
                seeds.append(_signed(found[at]))
            yield ids, k1, k2, seeds, places

    return map_stream(docs.select("doc_id", "text", "k1", "k2"), run,
                      "doc_id long, k1 long, k2 long, seeds array<long>, at array<int>")


def _phrases(docs: DataFrame, window: int, seed_words: int) -> DataFrame:
    """Windows with a shared minimizer: ``(phrase, owner, sub, pos)``."""
    def run(batches):
        for ids, texts, owners, subs, shared in batches:
            for doc_id, text, owner, sub, at in zip(ids, texts, owners, subs, shared):
                if at is None or doc_id != owner:
                    continue
                words = word_hashes(text)
                _, anchors = minimizers(words, window, seed_words)
                pos = np.flatnonzero(np.isin(anchors, at))
                hashes = _signed(run_hashes(words, window)[pos])
                yield (hashes, np.full(len(pos), owner), np.full(len(pos), sub, np.int32),
                       pos.astype(np.int32))

    return map_stream(docs, run, "phrase long, owner long, sub int, pos int")


def _runs(hits: DataFrame) -> DataFrame:
    """``(owner, sub, start, n, times, ref)``: the longest runs of phrases of a text
    whose earliest places follow each other too. Where a text repeats itself, equal
    runs behind each other are one row, ``times`` long."""
    order = W.partitionBy("owner", "sub").orderBy("pos")
    goes_on = ((F.col("pos") == F.lag("pos").over(order) + 1)
               & (F.col("ref.owner") == F.lag("ref.owner").over(order))
               & (F.col("ref.sub") == F.lag("ref.sub").over(order))
               & (F.col("ref.pos") == F.lag("ref.pos").over(order) + 1))
    # a repeated row of documents finds each phrase twice, at the same place
    repeated = F.coalesce(F.col("pos") == F.lag("pos").over(order), F.lit(False))
    runs = (hits.withColumn("repeated", repeated)
            .withColumn("starts", F.when(goes_on | F.col("repeated"), 0).otherwise(1))
            .withColumn("run", F.sum("starts").over(order))
            .filter("NOT repeated").groupBy("owner", "sub", "run")
            .agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"),
                 F.min("ref").alias("ref")).drop("run"))
    order = W.partitionBy("owner", "sub").orderBy("start")
    again = ((F.lag("n").over(order) == F.col("n")) & (F.lag("ref").over(order) == F.col("ref"))
             & (F.lag("start").over(order) + F.col("n") == F.col("start")))
    return (runs.withColumn("fresh", F.when(again, 0).otherwise(1))
            .withColumn("run", F.sum("fresh").over(order)).groupBy("owner", "sub", "run")
            .agg(F.min("start").alias("start"), F.min("n").alias("n"),
                 F.count(F.lit(1)).alias("times"), F.min("ref").alias("ref")).drop("run"))


def _stretches(runs: DataFrame) -> DataFrame:
    """The runs with an earlier document as reference, and the stretch ``[lo, hi)`` of
    consecutive windows that each lies in."""
    order = W.partitionBy("owner", "sub").orderBy("start")
    stretch = W.partitionBy("owner", "sub", "stretch")
    end = F.col("start") + F.col("n") * F.col("times")
    apart = F.coalesce(F.lag(end).over(order) != F.col("start"), F.lit(True))
    return (runs.filter("ref.owner < owner").withColumn("apart", apart.cast("int"))
            .withColumn("stretch", F.sum("apart").over(order)).drop("apart")
            .withColumn("lo", F.min("start").over(stretch))
            .withColumn("hi", F.max(end).over(stretch))
            .withColumn("runs", F.sum("times").over(stretch)))


def _parse(hits: DataFrame, window: int) -> DataFrame:
    """Greedy factors of each text: ``(owner, sub, start, n_words, ref)``."""
    runs = materialize(_runs(hits))
    found = materialize(_stretches(runs))
    alone = found.filter("runs = 1").select("owner", "sub", "start", "n", "ref")
    text = ["owner", "sub", "stretch"]
    wanted = (found.filter("runs > 1")
              .withColumn("r_owner", F.col("ref.owner")).withColumn("r_sub", F.col("ref.sub"))
              .groupBy(*text, "r_owner", "r_sub")
              .agg(F.min(F.col("ref.pos") - F.col("start") - F.col("n") * (F.col("times") - 1)
                         + F.col("lo")).alias("r_lo"),
                   F.max(F.col("ref.pos") - F.col("start") + F.col("hi")).alias("r_hi"),
                   F.collect_list(F.struct("start", "n", "times", F.col("ref.pos").alias("at")))
                   .alias("own")))
    wanted = materialize(wanted)
    keys = ["r_owner", "r_sub"]
    traces = runs.select(F.col("owner").alias("r_owner"), F.col("sub").alias("r_sub"),
                         F.col("start").alias("s"), F.col("n").alias("m"), "times", F.col("ref").alias("to"))
    near = _dealt(wanted.drop("own"), traces, keys, text, wanted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"))).filter("s < r_hi AND s + m * times > r_lo")
    near = near.groupBy(*text, *keys).agg(F.collect_list(F.struct("s", "m", "times", "to")).alias("trace"))
    whole = wanted.join(near, [*text, *keys], "left").groupBy(*text).agg(F.collect_list(F.struct(
        *keys, "r_lo", "r_hi", "own", F.coalesce("trace", F.array()).alias("trace"))).alias("refs"))

    def run(batches):
        for owners, subs, all_refs in batches:
            out = [(o, b, *f) for o, b, refs in zip(owners, subs, all_refs)
                   for f in greedy_factors(refs)]
            if out:
                *cols, r_owner, r_sub, r_pos = map(list, zip(*out))
                yield (*cols, [{"owner": o, "sub": b, "pos": p}
                               for o, b, p in zip(r_owner, r_sub, r_pos)])

    parsed = map_stream(whole.select("owner", "sub", "refs"), run,
                        "owner long, sub int, start int, n long, "
                        "ref struct<owner: long, sub: int, pos: int>")
    return alone.unionByName(parsed).withColumn("n_words", F.col("n") + (window - 1)).drop("n")


def greedy_factors(refs: list[dict]) -> list[tuple]:
    """``(start, n, r_owner, r_sub, r_pos)`` of the factors of one stretch, in windows.
    ``refs`` are its references: the stretch's runs in each (``own``), and the part of
    the reference, ``[r_lo, r_hi)``, with its runs that have earlier places (``trace``)."""
    refs = sorted(refs, key=lambda r: (r["r_owner"], r["r_sub"]))
    code = {(r["r_owner"], r["r_sub"]): k << 40 for k, r in enumerate(refs)}
    lo = min(o["start"] for r in refs for o in r["own"])
    hi = max(o["start"] + o["n"] * o["times"] for r in refs for o in r["own"])
    text = np.empty(hi - lo, np.int64)
    for k, r in enumerate(refs):
        for o in r["own"]:
            long = o["n"] * o["times"]
            text[o["start"] - lo:o["start"] - lo + long] = (
                (k << 40) + o["at"] + np.arange(long) % o["n"])
    best = np.zeros(len(text), np.int64)
    ref, place = np.zeros((2, len(text)), np.int64)
    for k, r in enumerate(refs):
        first = max(r["r_lo"], 0)
        other = (k << 40) + np.arange(first, r["r_hi"])
        for t in r["trace"]:
            a, z = max(t["s"], first), min(t["s"] + t["m"] * t["times"], r["r_hi"])
            base = code.get((t["to"]["owner"], t["to"]["sub"]))
            if a < z:
                other[a - first:z - first] = -1 if base is None else (
                    base + t["to"]["pos"] + (np.arange(a, z) - t["s"]) % t["m"])
        length, at = longest_matches(text, other)
        longer = length > best
        best[longer], ref[longer], place[longer] = length[longer], k, first + at[longer]
    out, q = [], 0
    while q < len(text):
        r = refs[ref[q]]
        out.append((lo + q, int(best[q]), r["r_owner"], r["r_sub"], int(place[q])))
        q += int(best[q])
    return out


def longest_matches(text: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every position of ``text`` the length and place of its longest match in
    ``other``: both are ranked together by prefix doubling, a position's longest match
    begins at one of its neighbours of ``other`` in the order of the suffixes."""
    n, m = len(text), len(other)
    both = np.concatenate([text, [-2], other, [-3]])
    rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    while step < len(both) and rank.max() < len(both) - 1:
        ahead = np.zeros(len(both), np.int64)
        ahead[:-step] = rank[step:] + 1
        rank = np.unique(rank * (len(both) + 1) + ahead, return_inverse=True)[1]
        ranks.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    theirs = order > n
    spot = np.arange(len(both))
    before = np.maximum.accumulate(np.where(theirs, spot, -1))
    after = np.minimum.accumulate(np.where(theirs, spot, len(both))[::-1])[::-1]
    mine = np.argsort(order, kind="stable")[:n]
    length, place = np.zeros((2, n), np.int64)
    for near in (before[mine], after[mine]):
        known = (near >= 0) & (near < len(both))
        start = order[np.where(known, near, 0)]
        same = np.zeros(n, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            i, j = np.arange(n) + same, start + same
            fits = known & (i < len(both)) & (j < len(both))
            fits[fits] = ranks[k][i[fits]] == ranks[k][j[fits]]
            same[fits] += 1 << k
        longer = same > length
        length[longer], place[longer] = same[longer], start[longer] - n - 1
    return length, place


def _text_factors(docs: DataFrame, window: int, seed_words: int) -> tuple[DataFrame, DataFrame]:
    """``texts(k1, k2, owner, sub)``, one row per distinct text, and its factors."""
    anchors = materialize(_anchors(docs, window, seed_words))
    texts = materialize(
        anchors.filter("doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("owner"))
        .withColumn("sub", F.row_number().over(W.partitionBy("owner").orderBy("k1", "k2"))))
    seeds = (anchors.join(texts, ["k1", "k2"]).filter("doc_id = owner")
             .select("owner", "sub", F.explode(F.arrays_zip("seeds", "at")).alias("s"))
             .select("owner", "sub", F.col("s.seeds").alias("seed"), F.col("s.at").alias("at")))
    who = F.struct("owner", "sub")
    shared = materialize(
        seeds.groupBy("seed").agg(F.min(who).alias("a"), F.max(who).alias("b"),
                                  F.count(F.lit(1)).alias("n"))
        .filter("a <> b").select("seed", "n"))
    wanted = (_dealt(seeds, shared.select("seed"), ["seed"], ["owner", "sub"], shared)
              .groupBy("owner", "sub")
              .agg(F.collect_set("at").alias("at")).join(texts, ["owner", "sub"]))
    asked = docs.join(wanted, ["k1", "k2"], "left").select("doc_id", "text", "owner", "sub", "at")
    phrases = _phrases(asked, window, seed_words)
    index = materialize(
        phrases.groupBy("phrase")
        .agg(F.min(F.struct("owner", "sub", "pos")).alias("ref"), F.max("owner").alias("last"),
             F.count(F.lit(1)).alias("n"))
        .filter("ref.owner < last").drop("last"))  # phrases that can answer at all
    hits = _dealt(phrases, index.drop("n"), ["phrase"], ["owner", "sub"],
                  index.select("phrase", "n")).filter(
        F.col("ref") != F.struct("owner", "sub", "pos")).select("owner", "sub", "pos", "ref")
    return texts, _parse(hits, window)


def _dealt(askers: DataFrame, answers: DataFrame, keys: list[str], by: list[str],
           counts: DataFrame) -> DataFrame:
    """Inner join on ``keys``. A key asked for by more than ``1 / (4 * partitions)`` of
    all askers (``counts``: keys, n) is dealt into cells: its askers by the columns
    ``by``, its answers into every cell."""
    cells = 4 * int(askers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = counts.agg(F.sum("n")).first()[0] or 0
    hot = (counts.filter(F.col("n") * cells > asked)  # fewer than ``cells`` rows
           .select(*keys, F.ceil(F.col("n") * cells / F.lit(max(asked, 1))).alias("parts")))
    hot = F.broadcast(materialize(hot))
    one = F.lit(0).cast("long")
    askers = askers.join(hot, keys, "left").withColumn("cell", F.coalesce(
        F.pmod(F.xxhash64(*by), F.col("parts")), one)).drop("parts")
    answers = (answers.join(hot, keys, "left")
               .withColumn("cell", F.explode(F.sequence(one, F.coalesce("parts", F.lit(1)) - 1)))
               .drop("parts"))
    return askers.join(answers, [*keys, "cell"]).drop("cell")


def _keyed(docs: DataFrame) -> DataFrame:
    return doc_texts(docs).select("doc_id", "text", *text_key(F.col("text")))


def factors(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """Duplicate factors of each distinct text, under its smallest doc_id:
    ``(doc_id, start, n_words, ref_doc_id, ref_start)`` in words."""
    _, found = _text_factors(_keyed(docs), window, seed_words)
    return found.select(F.col("owner").alias("doc_id"), "start", "n_words",
                        F.col("ref.owner").alias("ref_doc_id"), F.col("ref.pos").alias("ref_start"))


def remove_repeats(docs: DataFrame, window: int = WINDOW,
                   seed_words: int = SEED_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``, one row per row of ``docs``;
    ``kept`` are the words that stay, joined by one space."""
    keyed = _keyed(docs)
    texts, found = _text_factors(keyed, window, seed_words)
    spans = found.groupBy("owner", "sub").agg(F.collect_list(
        F.struct("start", F.col("n_words").cast("int").alias("n"))).alias("spans"))
    judged = keyed.join(texts.join(spans, ["owner", "sub"], "left"), ["k1", "k2"], "left").select(
        "doc_id", "text", "owner", "spans")

    def run(batches):
        for ids, all_texts, owners, all_spans in batches:
            n_words, n_removed, kept = [], [], []
            for doc_id, text, owner, spans_ in zip(ids, all_texts, owners, all_spans):
                words = text.encode().split()
                stays = np.ones(len(words), bool)
                if doc_id is not None and doc_id > owner:
                    stays[:] = len(words) < window
                elif doc_id is not None:
                    for s in spans_ or ():
                        stays[s["start"]:s["start"] + s["n"]] = False
                n_words.append(len(words))
                n_removed.append(int((~stays).sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stays).tolist()]).decode()
                            if not stays.all() else b" ".join(words).decode())
            yield ids, n_words, n_removed, kept

    return map_stream(judged, run, "doc_id long, n_words long, n_removed long, kept string")
