"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Method. Every text is cut into pre-tokens (the tokenizer's pattern). A block of
consecutive documents keeps its distinct pre-tokens once and, for every
position, the number of the pre-token in that dictionary. The dictionaries are
shuffled by the hash of the word, so all copies of a word meet in one
partition, where each distinct word is encoded exactly once; its ids travel
back to the blocks that asked for it, and each block puts the ids in the order
of its positions. A word counts once per block however often it occurs, so
frequent words are no hot keys; what is shuffled is dictionaries and compressed
word numbers, not rows of tokens.

Decoding joins ids with the table of token bytes. That table is the rank file
itself (50,256 entries here, fixed by the file and independent of the data).

Cases: null or empty text: no ids, empty bytes. Repeated rows and ids are kept
row by row. A very long text is one block of its own. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
from collections import defaultdict
from functools import lru_cache

import numpy as np
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, map_stream

#: Characters of text in one block (a longer text makes a block of its own).
BLOCK_CHARS = 5_000_000
#: Compression level of what is shuffled.
LEVEL = 3


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _word_encoder(ranks: dict[bytes, int], pattern: str):
    """bytes of one pre-token -> ids, the library's merge loop on a single piece."""
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return enc._encode_single_piece


def _pack(array: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Integers as byte planes (high bytes are mostly zero), compressed."""
    planes = array.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return squeeze.compress(np.ascontiguousarray(planes).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<u4")


def _blocks(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """One row per block: its documents, the word number at every position, and
    its distinct words by bucket. Words are numbered by falling frequency;
    ``slots`` are the numbers of the words in the order of the buckets."""
    def run(batches):
        findall = regex.compile(pattern).findall
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        sequence = itertools.count(TaskContext.get().partitionId() << 32)

        def emit(ids, counts, parts, numbers):
            positions, words = np.concatenate(parts), list(numbers)
            by_rank = np.argsort(-np.bincount(positions, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[by_rank] = np.arange(len(words))
            words = [words[i].encode() for i in by_rank.tolist()]
            owner = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words),
                                dtype=np.int64, count=len(words))
            slots = np.argsort(owner, kind="stable")
            dictionary = []
            for part in np.split(slots, np.flatnonzero(np.diff(owner[slots])) + 1):
                chosen = [words[i] for i in part.tolist()]
                if chosen:
                    lengths = np.fromiter(map(len, chosen), dtype=np.uint32, count=len(chosen))
                    dictionary.append({"bucket": int(owner[part[0]]),
                                       "lengths": _pack(lengths, squeeze),
                                       "bytes": squeeze.compress(b"".join(chosen))})
            return ([next(sequence)], [ids], [counts], [_pack(rank[positions], squeeze)],
                    [_pack(slots, squeeze)], [dictionary])

        fresh = lambda: ([], [], [], defaultdict(itertools.count().__next__))
        ids, counts, parts, numbers = fresh()
        size = 0
        for doc_ids, texts in batches:
            for doc_id, text in zip(doc_ids, texts):
                if ids and size + len(text) > BLOCK_CHARS:
                    yield emit(ids, counts, parts, numbers)
                    ids, counts, parts, numbers = fresh()
                    size = 0
                found = findall(text)
                ids.append(doc_id)
                counts.append(len(found))
                parts.append(np.fromiter(map(numbers.__getitem__, found), dtype=np.uint32,
                                         count=len(found)))
                size += len(text)
        if ids:
            yield emit(ids, counts, parts, numbers)

    return map_stream(docs, run, "block long, doc_ids array<long>, counts array<int>, "
                      "positions binary, slots binary, "
                      "words array<struct<bucket:int,lengths:binary,bytes:binary>>")


def _words(blocks: DataFrame) -> DataFrame:
    """A row per block and bucket. A map over whole rows, not an explode of one
    column: it reads the blocks' shuffle as it is, so that the reassembly can use
    the same shuffle again."""
    def run(batches):
        for block, *_, words in batches:
            rows = [(b, w["bucket"], w["lengths"], w["bytes"]) for b, ws in zip(block, words)
                    for w in ws]
            if rows:
                yield tuple(map(list, zip(*rows)))

    return map_stream(blocks, run, "block long, bucket int, lengths binary, bytes binary")


def _encode_words(words: DataFrame, ranks, pattern: str) -> DataFrame:
    """Rows already dealt by bucket: encode each distinct word of the partition
    once, and answer every block's list of words with the ids."""
    def run(batches):
        encode = _word_encoder(ranks.value, pattern)
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        known: dict[bytes, list[int]] = {}
        for blocks, buckets, lengths, blobs in batches:
            counts, flat = [], []
            for length, blob in zip(lengths, blobs):
                raw = zstandard.ZstdDecompressor().decompress(blob)
                ends = np.cumsum(_unpack(length), dtype=np.int64).tolist()
                answer = []
                for start, end in zip([0, *ends[:-1]], ends):
                    word = raw[start:end]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encode(word)
                    answer.append(ids)
                counts.append(_pack(np.fromiter(map(len, answer), np.uint32, len(answer)), squeeze))
                flat.append(_pack(np.fromiter(itertools.chain.from_iterable(answer), np.uint32),
                                  squeeze))
            yield blocks, buckets, counts, flat

    return map_stream(words, run, "block long, bucket int, n_ids binary, ids binary")


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of ``[start, start + length)`` ranges."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _decoder(ranks):
    """ids (little-endian bytes) -> text bytes, by the token-byte table."""
    table = {rank: token for token, rank in ranks.value.items()}
    return lambda ids: b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _reassemble(blocks: DataFrame, ranks=None) -> DataFrame:
    """Each block's ids in the order of its positions; with ``ranks`` decoded as well,
    in the same pass (a second one would need another Python worker per task)."""
    def one(doc_ids, counts, positions, slots, answers):
        answers = sorted(answers or [], key=lambda a: a["bucket"])
        flat = (np.concatenate([_unpack(a["ids"]) for a in answers]) if answers
                else np.zeros(0, "<u4"))
        n = (np.concatenate([_unpack(a["n_ids"]) for a in answers]).astype(np.int64) if answers
             else np.zeros(0, np.int64))
        slot = _unpack(slots)
        starts, lengths = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        starts[slot], lengths[slot] = np.cumsum(n) - n, n
        at = _unpack(positions)
        done = 0
        for doc_id, count in zip(doc_ids, counts):
            words = at[done:done + count]
            done += count
            ids = flat[_ragged(starts[words], lengths[words])]
            yield doc_id, len(ids), ids.astype("<u4").tobytes()

    def run(batches):
        decoded = _decoder(ranks) if ranks else None
        for columns in batches:
            _, doc_ids, counts, positions, slots, _, answers = columns
            for row in zip(doc_ids, counts, positions, slots, answers):
                rows = one(*row)
                while out := list(itertools.islice(rows, 500)):
                    columns_out = tuple(map(list, zip(*out)))
                    yield (*columns_out, list(map(decoded, columns_out[2]))) if ranks else columns_out

    return map_stream(blocks, run, "doc_id long, n_tokens long, ids binary"
                      + ", decoded binary" * bool(ranks))


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids)``; ``ids`` are little-endian unsigned 32-bit. With
    ``decoded`` also the bytes that the ids decode to."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(path))  # as large as the rank file, no more
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(doc_texts(docs), pattern, partitions).repartition(partitions, "block")
    words = _words(blocks).repartition("bucket")
    answers = (_encode_words(words, ranks, pattern)
               .groupBy("block").agg(F.collect_list(F.struct("bucket", "n_ids", "ids")).alias("a")))
    return _reassemble(blocks.join(answers, "block", "left")
                       .select(*blocks.columns, "a"),  # every column: the shuffle is used again
                       ranks if decoded else None)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``: the bytes of each row's ids, from the token-byte table."""
    columns = [c for c in encoded.columns if c != "decoded"]
    at = columns.index("ids")
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches):
        decoded = _decoder(ranks)
        for cols in batches:
            yield (*cols, list(map(decoded, cols[at])))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in encoded.select(*columns).schema)
    return map_stream(encoded.select(*columns), run, f"{schema}, decoded binary")
