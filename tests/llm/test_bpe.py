import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from demand_engine.llm import bpe, queries
from demand_engine.llm.common import read_table

from .helpers import TEXTS, documents, rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = tiktoken.Encoding("ours", pat_str=public_tokenizers.PATTERN,
                            mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def expected(doc_id, text):
    ids = LIBRARY.encode_ordinary(text or "")
    return (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_every_row_as_the_library(spark):
    got = rows(queries.bpe_digest(documents(spark)))
    assert got == sorted((expected(*r) for r in TEXTS), key=repr)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 10)
    got = rows(queries.bpe_digest(documents(spark).repartition(3)))
    assert got == sorted((expected(*r) for r in TEXTS), key=repr)


def test_decode_is_the_inverse(spark):
    tokens = bpe.decode(bpe.encode(documents(spark), PATH, public_tokenizers.PATTERN), PATH)
    back = sorted((r.doc_id is None, r.doc_id, bytes(r.decoded).decode()) for r in tokens.collect()
                  if r.doc_id is not None)
    assert back == sorted((False, i, t or "") for i, t in TEXTS if i is not None)


def test_empty_table(spark):
    assert queries.bpe_digest(documents(spark, []).limit(0)).collect() == []


def test_query_on_the_whole_table(spark, sf_small):
    texts = [(r.doc_id, r.text) for r in read_table(spark, sf_small, "documents").collect()]
    assert rows(queries.op1_byte_bpe(spark, sf_small)) == sorted((expected(*t) for t in texts), key=repr)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1)))
def test_packing_round_trip(numbers):
    import zstandard
    packed = bpe._pack(np.array(numbers, np.uint32), zstandard.ZstdCompressor())
    assert bpe._unpack(packed).tolist() == numbers
