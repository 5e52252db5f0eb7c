import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from demand_engine.llm import align, queries
from demand_engine.llm.common import read_table

from .helpers import TEXTS, documents

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LIB_A = Tokenizer.from_file(BYTES)
LIB_A.encode_special_tokens = True
LIB_B = sentencepiece.SentencePieceProcessor(model_file=PIECES)
ALPHABET = align.byte_alphabet()
MORE = [(40, "a  b   c\n d\n\n  e \t f"), (41, "▁ literal"), (42, " lead and trail  "),
        (43, "<|endoftext|> <s> </s> <unk> <0x41>"), (44, "it's we'll 'tis ''s"),
        (45, "½ ﬁ ﷺ é 　 x y \x85  z 😀👍🏽"), (46, "word " * 500)]


def tokens(text):
    """[(id, bytes)] of both sides by the libraries, on the whole text."""
    a = LIB_A.encode(" " + text, add_special_tokens=False).ids
    side_a = [(i, bytes(ALPHABET[c] for c in LIB_A.id_to_token(i))) for i in a]
    side_b = []
    for i in LIB_B.encode(text):
        piece = LIB_B.id_to_piece(i)
        side_b.append((i, bytes([int(piece[3:5], 16)]) if LIB_B.is_byte(i)
                       else piece.replace("▁", " ").encode()))
    return side_a, side_b


def brute_one(text):
    if not text:
        return [], [], [], ""
    a, b = tokens(text)
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
        return [], [], [], ""
    owner_a = [k for k, (_, x) in enumerate(a) for _ in x]
    owner_b = [k for k, (_, x) in enumerate(b) for _ in x]
    links = sorted(set(zip(owner_a, owner_b)))
    ends = sorted({i for i in range(1, len(owner_a) + 1)
                   if (i == len(owner_a) or owner_a[i] != owner_a[i - 1])
                   and (i == len(owner_b) or owner_b[i] != owner_b[i - 1])})
    groups, start = [], 0
    for end in ends:
        groups.append("|".join(",".join(str(side[k][0]) for k in sorted(set(owner[start:end])))
                               for side, owner in ((a, owner_a), (b, owner_b))))
        start = end
    return [i for i, _ in a], [i for i, _ in b], links, ";".join(groups)


def brute(texts):
    each = [brute_one(t) for _, t in texts]
    held = Counter(p for a, b, links, _ in each for p in {(a[x], b[y]) for x, y in links})
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (i, _), (a, b, links, groups) in zip(texts, each):
        pairs = [(a[x], b[y]) for x, y in links]
        out.append((i, len(a), len(b), groups.count("|"), len(links),
                    sum(held[p] == best[p[0]] for p in pairs), sum(held[p] for p in pairs),
                    hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def counted(docs):
    return sorted(map(tuple, align.linked_counts(docs, BYTES, PIECES, P.PATTERN).collect()), key=repr)


def test_awkward_documents(spark):
    assert counted(documents(spark, TEXTS + MORE)) == brute(TEXTS + MORE)


def test_small_batches_and_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(align, "BATCH_CHARS", 20)
    monkeypatch.setattr(align, "BLOCK_CHARS", 50)
    assert counted(documents(spark, TEXTS + MORE).repartition(3)) == brute(TEXTS + MORE)


def test_empty_table(spark):
    assert counted(documents(spark).limit(0)) == []


def test_query_on_the_whole_table(spark, sf_small):
    texts = [(r.doc_id, r.text) for r in read_table(spark, sf_small, "documents").collect()]
    got = sorted(map(tuple, queries.op12_token_alignment(spark, sf_small).collect()), key=repr)
    assert got == brute(texts)


def test_links_and_groups_of_each_document(spark):
    texts = [t for t in TEXTS + MORE if t[0] is not None and t[0] not in (5, 8, 9)]
    got = {r.doc_id: r for r in align.align(documents(spark, texts), BYTES, PIECES, P.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        a, b, links, groups = brute_one(text)
        r = got[i]
        assert (r.a_ids, r.b_ids, sorted((x.a, x.b) for x in r.links), r.groups) == (a, b, links, groups)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(1, 30)), min_size=1, max_size=4))
def test_overlaps_of_any_cuts(cuts):
    for left in cuts:
        for right in cuts:
            a, b = ([0, *sorted(x - {31}), 31] for x in (left, right))
            got = align.overlaps(np.array(a[:-1]), np.array(b[:-1]))
            want = {(i, j) for i in range(len(a) - 1) for j in range(len(b) - 1)
                    if max(a[i], b[j]) < min(a[i + 1], b[j + 1])}
            assert sorted(zip(*map(np.ndarray.tolist, got))) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab '.\n\t1é▁ 日 \x1c\x85😀"), max_size=30))
def test_tokens_of_any_text_as_the_libraries(text):
    found = align.align_batch([text], TOKENIZERS)
    a, b, _, groups = brute_one(text)
    assert (found.a.tolist(), found.b.tolist(), *align.group_texts(found, TOKENIZERS.texts)) == (a, b, groups)


with open(BYTES, "rb") as _a, open(PIECES, "rb") as _b:
    TOKENIZERS = align.Tokenizers(_a.read(), _b.read(), P.PATTERN)
