"""Alignment of two tokenizers' tokens over the same text.

Method. Both sides' tokens cover the same bytes (a space and the text). A batch of
documents is one pair of pandas frames, sorted by the byte at which a token
starts; every document has its own range of bytes in them, which keys the search
by document. ``merge_asof`` gives each token start of one side the covering token
of the other side; the union of both directions is every overlapping pair once.
Bytes where tokens of both sides end cut the tokens into groups.

Corpus counts. How many documents hold an id pair linked is counted over all
documents: a block of consecutive documents keeps its distinct pairs once, with
the number of its documents that hold each; the blocks' pairs are summed (with
partial aggregates), and the sums travel back to the blocks by a join on the pair.
What is shuffled is a row per block and distinct pair, not per link. A frequent
pair counts once per block, and its rows can be split by adaptive execution. An A
id has at most as many partners as the other side has ids.

Tokenizing. Neither side's tokens cross a place where a space follows a character
that is not white space (the byte-level side cuts there before merging; the
pieces of the other side hold spaces only in front, which is checked when the
model is loaded). A block is cut there and each distinct piece of text is
tokenized once: the byte-level side by the merge loop of a public library under
the vocabulary's own ranks, the other by its own library.

Cases: a null or empty text, or one whose tokens do not spell it (a literal
U+2581), has no tokens and counts nowhere. The strings of special tokens are
plain text. Repeated rows and ids count row by row. A very long text makes a
batch and a block of its own. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import _pack, _ragged, _unpack
from .common import doc_texts, map_stream, materialize

#: Characters of text in one batch of the alignment, and in one block of the counts.
BATCH_CHARS = 1_500_000
BLOCK_CHARS = 4_000_000
SPACE = "▁"
#: Spaces and what follows, up to a space after a character that is not white space.
_PIECE = re.compile(r" +[^ ]*(?:(?<=\s) +[^ ]*)*")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others for the characters from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in printable}
    rest = [b for b in range(256) if chr(b) not in table]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both sides: ids and byte lengths of the tokens of a piece of text."""

    def __init__(self, byte_file: bytes, piece_file: bytes, pattern: str):
        model = json.loads(byte_file)["model"]
        alphabet = byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, token)): i for token, i in model["vocab"].items()
                 if all(c in alphabet for c in token)}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))]
                  for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the vocabulary's ids are not in the order of its merges")
        self._a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._len_a = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self._len_a[i] = len(token)
        self._b = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space inside; texts cannot be cut at spaces")
        self._bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i)
                         else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        ids = range(max(len(self._len_a), len(pieces)))
        self.texts = np.array([[f"{i}{mark}" for mark in ",|;"] for i in ids], object)
        self._lone_space = pieces.index(SPACE)
        self._len_b = np.fromiter(map(len, self._bytes_b), np.int64, len(pieces))

    def a(self, pieces: list[str]) -> list[list[int]]:
        return list(map(self._a.encode_ordinary, pieces))

    def b(self, pieces: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """Ids of each piece (which starts with a space, as the library adds one), and
        whether they spell it."""
        ids = self._b.encode([p[1:] for p in pieces], num_threads=1)
        ids = [i if p != " " else [self._lone_space] for i, p in zip(ids, pieces)]  # nothing for ''
        spelled = (b"".join(map(self._bytes_b.__getitem__, i)) == p.encode()
                   for i, p in zip(ids, pieces))
        return ids, np.fromiter(spelled, bool, len(pieces))

    def bytes_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._len_a[a], self._len_b[b]


def sent(spark: SparkSession, byte_path: str, piece_path: str):
    """The two files' bytes for the executors: as large as the files, no more."""
    files = []
    for path in (byte_path, piece_path):
        with open(path, "rb") as f:
            files.append(f.read())
    return spark.sparkContext.broadcast(tuple(files))


@dataclass
class Aligned:
    """Tokens, links and groups of a batch of documents; ``ends_*`` and ``cuts`` are the
    ends of each document's tokens and groups in the flat arrays, ``doc`` the document
    of a link."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    doc: np.ndarray
    group_a: np.ndarray  # ends of the groups, as numbers of A tokens
    group_b: np.ndarray
    cuts: np.ndarray


def overlaps(start_a: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (A token, B token) that share a byte, given the sorted token starts."""
    a = pd.DataFrame({"at": start_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"at": start_b, "b": np.arange(len(start_b))})
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    covering_b = pd.merge_asof(a, b, on="at")["b"].to_numpy()
    covering_a = pd.merge_asof(b, a, on="at")["a"].to_numpy()
    late = start_a[covering_a] != start_b  # equal starts were found from the other side
    link_a = np.concatenate([a["a"].to_numpy(), covering_a[late]])
    link_b = np.concatenate([covering_b, b["b"].to_numpy()[late]])
    order = np.argsort(link_a + link_b, kind="stable")
    return link_a[order], link_b[order]


def tokens_of(texts: list[str], tokenizers: Tokenizers):
    """Flat ids of both sides and the ends of each document's tokens."""
    numbers: dict[str, int] = defaultdict(itertools.count().__next__)
    parts = [np.fromiter(map(numbers.__getitem__, _PIECE.findall(" " + t) if t else ()), np.int64)
             for t in texts]
    pieces = list(numbers)
    ids_a = tokenizers.a(pieces)
    ids_b, spelled = tokenizers.b(pieces)
    parts = [p if spelled[p].all() else p[:0] for p in parts]
    words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    doc_ends = np.cumsum([len(p) for p in parts])
    out = []
    for ids in (ids_a, ids_b):
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64)
        starts = np.cumsum(n) - n
        tokens = flat[_ragged(starts[words], n[words])]
        ends = np.concatenate([[0], np.cumsum(n[words])])[doc_ends]
        out += [tokens, ends]
    return out


def align_batch(texts: list[str], tokenizers: Tokenizers) -> Aligned:
    a, ends_a, b, ends_b = tokens_of(texts, tokenizers)
    len_a, len_b = tokenizers.bytes_of(a, b)
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)  # documents lie one after the other
    link_a, link_b = overlaps(end_a - len_a, end_b - len_b)
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(end_a, both) + 1, np.searchsorted(end_b, both) + 1
    return Aligned(a, b, ends_a, ends_b, link_a, link_b,
                   np.searchsorted(ends_a, link_a, side="right"), group_a, group_b,
                   np.searchsorted(group_a, ends_a, side="right"))


def group_texts(found: Aligned, texts: np.ndarray) -> Iterator[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document, '' without tokens; ``texts`` has every
    id with each mark after it."""
    # every token's text with the mark that follows it; a group's A tokens, then its B tokens
    sizes_a, sizes_b = (np.diff(np.concatenate([[0], x])) for x in (found.group_a, found.group_b))
    mark_a, mark_b = np.zeros(len(found.a), np.int64), np.zeros(len(found.b), np.int64)
    mark_a[found.group_a - 1], mark_b[found.group_b - 1] = 1, 2
    every = np.empty(len(found.a) + len(found.b), object)
    every[np.arange(len(found.a)) + np.repeat(found.group_b - sizes_b, sizes_a)] = \
        texts[found.a, mark_a]
    every[np.arange(len(found.b)) + np.repeat(found.group_a, sizes_b)] = texts[found.b, mark_b]
    start = 0
    for end in (found.ends_a + found.ends_b).tolist():
        yield "".join(every[start:end].tolist())[:-1]
        start = end


def _batches(columns: Iterator[list], size: int) -> Iterator[tuple[list, list[str]]]:
    """Documents in runs of about ``size`` characters."""
    ids, texts, chars = [], [], 0
    for doc_ids, batch in columns:
        for doc_id, text in zip(doc_ids, batch):
            if ids and chars + len(text) > size:
                yield ids, texts
                ids, texts, chars = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            chars += len(text)
    if ids:
        yield ids, texts


def align(docs: DataFrame, byte_path: str, piece_path: str, pattern: str) -> DataFrame:
    """``(doc_id, a_ids, b_ids, links, groups)``: token ids of both sides, the linked
    token numbers and the ids of the groups as text."""
    files = sent(docs.sparkSession, byte_path, piece_path)

    def run(columns):
        tokenizers = Tokenizers(*files.value, pattern)
        for ids, texts in _batches(columns, BATCH_CHARS):
            found = align_batch(texts, tokenizers)
            a, b, at = [0, *found.ends_a], [0, *found.ends_b], np.searchsorted(
                found.doc, np.arange(len(ids) + 1))
            links = [np.stack([found.link_a[at[i]:at[i + 1]] - a[i],
                               found.link_b[at[i]:at[i + 1]] - b[i]], axis=1)
                     for i in range(len(ids))]
            yield (ids, [found.a[a[i]:a[i + 1]] for i in range(len(ids))],
                   [found.b[b[i]:b[i + 1]] for i in range(len(ids))],
                   [[{"a": x, "b": y} for x, y in pairs.tolist()] for pairs in links],
                   list(group_texts(found, tokenizers.texts)))

    return map_stream(doc_texts(docs), run, "doc_id long, a_ids array<int>, b_ids array<int>, "
                      "links array<struct<a:int,b:int>>, groups string")


def _blocks(docs: DataFrame, files, pattern: str) -> DataFrame:
    """One row per block: figures of its documents, the number of each document's
    distinct pairs, their slots in the block's dictionary and occurrences, and the
    dictionary (pair, documents of the block that hold it)."""
    schema = ("block long, docs array<struct<doc_id:long,n_a:int,n_b:int,n_groups:int,n_links:int,"
              "groups_sha256:string>>, sizes binary, slots binary, times binary, pairs binary, "
              "holders binary")

    def run(columns):
        tokenizers = Tokenizers(*files.value, pattern)
        squeeze = zstandard.ZstdCompressor(level=3)
        sequence = itertools.count(TaskContext.get().partitionId() << 32)

        def emit(rows, sizes, pairs, times):
            pairs, times = np.concatenate(pairs), np.concatenate(times)
            distinct, slots, holders = np.unique(pairs, return_inverse=True, return_counts=True)
            pack = lambda x: _pack(np.asarray(x), squeeze)
            return ([next(sequence)], [rows], [pack(np.concatenate(sizes))], [pack(slots)],
                    [pack(times)], [pack(distinct)], [pack(holders)])

        rows, sizes, pairs, times, chars = [], [], [], [], 0
        for ids, texts in _batches(columns, BATCH_CHARS):
            size = sum(map(len, texts))
            if rows and chars + size > BLOCK_CHARS:
                yield emit(rows, sizes, pairs, times)
                rows, sizes, pairs, times, chars = [], [], [], [], 0
            chars += size
            found = align_batch(texts, tokenizers)
            # ids below 2 ** 16 on both sides: a pair is 32 bits
            key = (found.doc << 32) | (found.a[found.link_a] << 16) | found.b[found.link_b]
            held, n = np.unique(key, return_counts=True)
            sizes.append(np.bincount(held >> 32, minlength=len(ids)))
            pairs.append((held & 0xFFFFFFFF).astype(np.uint32))
            times.append(n)
            per_doc = [np.diff(np.concatenate([[0], x])).tolist()
                       for x in (found.ends_a, found.ends_b, found.cuts)]
            links = np.bincount(found.doc, minlength=len(ids)).tolist()
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else ""
                       for t in group_texts(found, tokenizers.texts)]
            rows += [{"doc_id": i, "n_a": x, "n_b": y, "n_groups": g, "n_links": k,
                      "groups_sha256": d}
                     for i, x, y, g, k, d in zip(ids, *per_doc, links, digests)]
        if rows:
            yield emit(rows, sizes, pairs, times)

    return map_stream(doc_texts(docs), run, schema)


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``asked(block, slot, a, b, holders)``, a row per block and distinct pair, and
    ``counts(a, b, n_docs, best)``: documents that hold the pair, and whether that is
    the highest number of its A id."""
    def run(batches):
        for block, packed, holders in batches:
            for i, p, h in zip(block, packed, holders):
                pairs = _unpack(p).astype(np.int64)
                yield (np.full(len(pairs), i), np.arange(len(pairs), dtype=np.int32),
                       (pairs >> 16).astype(np.int32), (pairs & 0xFFFF).astype(np.int32),
                       _unpack(h).astype(np.int64))

    asked = map_stream(blocks.select("block", "pairs", "holders"), run,
                       "block long, slot int, a int, b int, holders long")
    counts = asked.groupBy("a", "b").agg(F.sum("holders").alias("n_docs"))
    highest = F.max("n_docs").over(W.partitionBy("a"))
    return asked, counts.withColumn("best", F.col("n_docs") == highest)


def linked_counts(docs: DataFrame, byte_path: str, piece_path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256)``."""
    files = sent(docs.sparkSession, byte_path, piece_path)
    blocks = materialize(_blocks(docs, files, pattern))
    asked, counts = pair_counts(blocks)
    counts = materialize(counts)
    answers = (asked.select("block", "slot", "a", "b").join(counts, ["a", "b"])
               .groupBy("block").agg(F.collect_list(F.struct("slot", "n_docs", "best")).alias("answers")))

    def run(batches):
        for block_docs, sizes, slots, times, answers_ in batches:
            for docs_, size, slot, time, answer in zip(block_docs, sizes, slots, times, answers_):
                answer = answer or []
                n_docs, best = np.zeros(len(answer), np.int64), np.zeros(len(answer), np.int64)
                at = np.fromiter((x["slot"] for x in answer), np.int64, len(answer))
                n_docs[at] = np.fromiter((x["n_docs"] for x in answer), np.int64, len(answer))
                best[at] = np.fromiter((x["best"] for x in answer), np.int64, len(answer))
                slot, time = _unpack(slot), _unpack(time).astype(np.int64)
                ends = np.cumsum(_unpack(size), dtype=np.int64)
                sums = [np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(
                    time * value[slot])])[ends]])).tolist() for value in (best, n_docs)]
                yield ([d["doc_id"] for d in docs_],
                       *[[d[c] for d in docs_] for c in ("n_a", "n_b", "n_groups", "n_links")],
                       *sums, [d["groups_sha256"] for d in docs_])

    joined = blocks.join(answers, "block", "left").select("docs", "sizes", "slots", "times", "answers")
    return map_stream(joined, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                      "n_best long, count_sum long, groups_sha256 string")
