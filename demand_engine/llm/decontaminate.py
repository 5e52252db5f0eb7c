"""Benchmark decontamination by greedy string tiling.

Words are lower-cased and cut at white space and ASCII punctuation. A document
and a test item that share a seed (``min_tile`` = 5 consecutive words, found by
running Karp-Rabin hashes and compared word by word) are tiled: the longest
common run of words not yet marked on either side is marked, again and again,
until no run of ``min_tile`` words is left. Each word of either side belongs to
one tile at most, so a passage whose sentences were reordered is covered as well
as a literal copy, and repeating one sentence covers it only once. A document
leaks an item if the tiles cover at least ``threshold`` of the item's words.

An item shorter than ``min_tile`` words has no seed. It is compared whole: a
document leaks it if a line or sentence of the document (cut at line breaks and
``.!?;:``) has exactly its words. A run inside a longer sentence does not count,
as a run of one or two words says nothing there.

The seed join runs against blocks of the test set. The items are dealt to blocks by
hash; blocks are measured (words by the same rule as the matching, and bytes) and
their number is doubled until none with several items is larger than
``block_words`` words or ``BYTES_A_WORD`` times as many bytes. Each block's seed
table is sent to the tasks and every document is held against it where it lies, so
the documents are never shuffled and no passage, however common, is a hot key. A
larger test set means more blocks, each another pass over the documents.

For one document, every seed of the block is looked at once, however often the
document repeats it, which gives the words of each item that tiles could reach;
the places in the document are listed only for items that can reach the threshold.

Cases: null or empty texts and items share nothing. Repeated document rows are
reported row by row, repeated item rows as often as they occur; equal items each by
their own id. Rows without doc_id or item_id are reported with a null there.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, column_function, doc_texts, map_stream

MIN_TILE = 5
THRESHOLD = 0.8
BLOCK_WORDS = 1_000_000
BYTES_A_WORD = 8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SENTENCE_END = re.compile(r"[\r\n.!?;:]+")
#: White space and ASCII punctuation for Spark: what ``words_of`` cuts at.
_CUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TO_SPACE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_TO_SPACE).split()


def _run_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``k`` word numbers."""
    out = np.zeros(max(len(ids) - k + 1, 0), np.uint64)
    for j in range(k):
        out = out * _BASE + ids[j:len(ids) - k + 1 + j]
    return out ^ (out >> np.uint64(31))


class SeedTable:
    """The seeds of a block of test items ``(item_id, text, rows)``: word numbers,
    sorted seed hashes; items without a seed by their words."""

    def __init__(self, items: list[tuple], k: int):
        self.k = k
        self.vocabulary: dict[bytes, int] = {}
        self.short: dict[tuple[bytes, ...], list[tuple[int | None, int]]] = {}
        self.ids, self.rows, self.words, hashes, owner, place = [], [], [], [], [], []
        for item_id, text, *rows in items:
            words = words_of(text)
            if len(words) < k:
                if words:
                    self.short.setdefault(tuple(words), []).append((item_id, *(rows or [1])))
                continue
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
                                for w in words], np.uint64)
            found = _run_hashes(numbers, k)
            hashes.append(found)
            owner.append(np.full(len(found), len(self.ids)))
            place.append(np.arange(len(found)))
            self.ids.append(item_id)
            self.rows.append(*(rows or [1]))
            self.words.append(numbers)
        if self.ids:
            seeds = np.concatenate(hashes)
            order = np.argsort(seeds, kind="stable")
            self.seeds = seeds[order]
            self.owner = np.concatenate(owner)[order]
            self.place = np.concatenate(place)[order]
            self.sizes = np.array([len(w) for w in self.words])

    def matches(self, text: str, threshold: float = 0.0
                ) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """The document's word numbers, and the places (document, item) of all
        shared seeds for each item of which runs could cover ``threshold``."""
        words, k = words_of(text), self.k
        numbers = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.uint64, len(words))
        runs = np.cumsum(np.r_[0, numbers != 0])
        at = np.flatnonzero(runs[k:] - runs[:-k] == k) if len(words) >= k and self.ids else []
        if not len(at):
            return numbers, {}
        hashes = np.zeros(len(at), np.uint64)
        for j in range(k):
            hashes = hashes * _BASE + numbers[at + j]
        hashes ^= hashes >> np.uint64(31)
        by_hash = np.argsort(hashes, kind="stable")
        at = at[by_hash]
        once, first, times = np.unique(hashes[by_hash], return_index=True, return_counts=True)
        low = np.searchsorted(self.seeds, once, "left")
        n = np.searchsorted(self.seeds, once, "right") - low
        entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        which = np.repeat(np.arange(len(once)), n)
        order = np.lexsort((self.place[entry], self.owner[entry]))
        entry, which = entry[order], which[order]
        owner, place = self.owner[entry], self.place[entry]
        if not len(entry):
            return numbers, {}
        start = np.flatnonzero(np.r_[True, np.diff(owner) != 0])
        reach = np.minimum(np.r_[np.diff(place), k], k)     # words up to the next seed
        reach[np.r_[start[1:], len(place)] - 1] = k
        reach = np.add.reduceat(reach, start)
        found = {}
        for g in np.flatnonzero(reach >= threshold * self.sizes[owner[start]]).tolist():
            mine = slice(start[g], start[g + 1] if g + 1 < len(start) else len(owner))
            i, w = int(owner[start[g]]), which[mine]
            t = times[w]
            p = at[np.repeat(first[w] - (np.cumsum(t) - t), t) + np.arange(t.sum())]
            q = np.repeat(place[mine], t)
            equal = np.ones(len(p), bool)
            for j in range(k):
                equal &= numbers[p + j] == self.words[i][q + j]
            found[i] = p[equal], q[equal]
        return numbers, found

    def whole(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """``(item_id, rows, document place, words)`` of the items without a seed
        that a line or sentence of the text consists of, at its first place."""
        found, at = {}, 0
        for part in _SENTENCE_END.split(text) if self.short else ():
            words = tuple(words_of(part))
            if words in self.short:
                found.setdefault(words, at)
            at += len(words)
        return [(item_id, rows, at, len(words)) for words, at in found.items()
                for item_id, rows in self.short[words]]


def tile(p: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from the places of all shared runs of ``k`` words:
    tiles ``(document place, item place, words)``, longest first, then leftmost."""
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    new = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(q) != 1)])
    sizes = np.diff(np.r_[new, len(p)])
    heap = [(-(n + k - 1), a, b) for n, a, b in
            zip(sizes.tolist(), p[new].tolist(), q[new].tolist())]
    heapq.heapify(heap)
    used_p, used_q, tiles = set(), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [a + j not in used_p and b + j not in used_q for j in range(-n)]
        if all(free):
            tiles.append((a, b, -n))
            used_p.update(range(a, a - n))
            used_q.update(range(b, b - n))
            continue
        start = None
        for j, is_free in enumerate([*free, False]):
            if is_free and start is None:
                start = j
            elif not is_free and start is not None:
                if j - start >= k:
                    heapq.heappush(heap, (start - j, a + start, b + start))
                start = None
    return tiles


def _leaks_of(table: SeedTable, doc_id, text: str, threshold: float):
    for item_id, rows, at, n in table.whole(text):
        for _ in range(rows):
            yield doc_id, item_id, n, n, 1.0, [{"doc_start": at, "item_start": 0, "n_words": n}]
    _, found = table.matches(text, threshold)
    for i, (p, q) in found.items():
        total = len(table.words[i])
        tiles = tile(p, q, table.k) if len(p) else []
        covered = sum(n for *_, n in tiles)
        if covered >= threshold * total and tiles:
            for _ in range(table.rows[i]):
                yield (doc_id, table.ids[i], covered, total, covered / total,
                       [{"doc_start": a, "item_start": b, "n_words": n} for a, b, n in tiles])


def _blocks(items: DataFrame, block_words: int) -> int:
    """The number of blocks that keeps each within ``block_words`` (a block of one
    item is as large as the item)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.greatest(F.size(F.split(text, _CUT)).cast("double"),
                      F.octet_length(text) / BYTES_A_WORD)
    sized = items.select(F.xxhash64("item_id", "text").alias("h"), size.alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    blocks = 1 + int(total // max(block_words, 1))
    while sized.groupBy(F.pmod("h", F.lit(blocks))).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).filter(
            (F.col("size") > block_words) & (F.col("n") > 1)).limit(1).count():
        blocks *= 2
    return blocks


def _seed_tables(benchmark: DataFrame, min_tile: int, block_words: int):
    """Broadcast seed tables, one per block of the test set."""
    spark = benchmark.sparkSession
    items = (benchmark.groupBy(F.col("item_id").cast("long").alias("item_id"), "text")
             .agg(F.count(F.lit(1)).alias("rows")))
    blocks = _blocks(items, block_words)
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        table = SeedTable([(r.item_id, r.text, r.rows) for r in part.collect()], min_tile)
        if table.ids or table.short:
            yield Sent(spark, table)


def leaks(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE,
          threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row and leaked item: ``(doc_id, item_id, covered,
    item_words, coverage, tiles)``."""
    schema = ("doc_id long, item_id long, covered long, item_words long, coverage double, "
              "tiles array<struct<doc_start:long,item_start:long,n_words:long>>")
    texts = doc_texts(docs)
    out = docs.sparkSession.createDataFrame([], schema)
    for sent in _seed_tables(benchmark, min_tile, block_words):
        def run(batches, sent=sent):
            for ids, batch in batches:
                rows = [row for doc_id, text in zip(ids, batch)
                        for row in _leaks_of(sent.value, doc_id, text, threshold)]
                if rows:
                    yield tuple(map(list, zip(*rows)))

        out = out.unionByName(map_stream(texts, run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE,
          threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that leak no test item; judged row by row where they
    lie, with no shuffle."""
    def judge(sent: Sent):
        def is_clean(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: next(_leaks_of(sent.value, None, t or "", threshold), None)
                             is None).astype(bool)
        return column_function(is_clean, "boolean")

    for sent in _seed_tables(benchmark, min_tile, block_words):
        docs = docs.filter(judge(sent)(F.coalesce(F.col("text"), F.lit(""))))
    return docs
