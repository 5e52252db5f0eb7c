import pytest
import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from demand_engine.llm import queries, secrets
from demand_engine.llm.common import read_table

from .helpers import TEXTS, documents

_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
                  for word in ("password", "passwd", "secret", "token", "api_?key"))


def brute_base(text):
    out = [(m.start(), 0, "assign", m.end()) for m in
           re.finditer(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text)
           if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)
            if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def ours(text):
    return secrets.joined([(k, a, b) for k, a, b, _ in secrets.base_matches(text)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWD", "secret", "toKen", "api_key", "APIKEY", "=", ":", " ",
                                 "'", '"', "abcdef", "AKIA", "Z9" * 8, "0f" * 12, "a", "x-/=", "ſecret",
                                 "toKen"]), max_size=9))
def test_base_matches_as_by_plain_patterns(pieces):
    assert ours("".join(pieces)) == brute_base("".join(pieces))


def test_query_on_the_whole_table(spark, sf_medium):
    texts = {r.doc_id: r.text for r in read_table(spark, sf_medium, "documents").collect()}
    got = queries.op5_secrets(spark, sf_medium).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        for kind in secrets.BASE_KINDS:
            assert r[f"n_{kind}"] == len(re.findall(rf"\b{kind}:", base))
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_merging_learns_the_loop():
    rng = random.Random(2)
    strings = {}
    for _ in range(400):
        s = "U" + "d" * rng.randint(4, 9)
        strings[s] = strings.get(s, 0) + 1
    learned = secrets.Automaton(strings)
    assert len(learned.next) < 12                     # the tree has more states
    assert learned.log_likelihood("Uddddddd") > learned.log_likelihood("dUdddddd") + 5
    mass = 0.0
    for string in ("U" + "d" * n for n in range(30)):
        mass += 2.718281828 ** learned.log_likelihood(string)
    assert 0.8 < mass <= 1.01


def test_a_credential_without_its_cue_is_found(spark):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOP0123456789") for _ in range(32))
    words = ["internationalization", "counterrevolutionary", "misunderstandings", "abcdefghijklmnop"]
    texts = [(i, f"{rng.choice(words)} of secret={key()} and {rng.choice(words)}") for i in range(200)]
    bare = key()
    texts += [(1000, f"see {bare} there"), (1001, " ".join(words))]
    docs = documents(spark, texts)
    found = {r.doc_id: r.spans for r in secrets.find_all(docs, secrets.fit(docs)).collect()}
    assert found[1000] == "format:4:36" and found[1001] == ""


def test_awkward_documents(spark):
    docs = documents(spark)
    model = secrets.fit(docs)
    assert model.automata == {}
    got = secrets.find_all(docs, model).collect()
    assert len(got) == len(TEXTS)
    assert next(r.spans for r in got if r.doc_id == 19) == "assign:0:49,hex:9:49,access:51:71"
    assert secrets.find_all(docs.limit(0), secrets.fit(docs.limit(0))).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB1.-=/ é,"), max_size=40))
def test_every_run_of_credential_characters_is_a_candidate(text):
    brute = []
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text):
        start, end = m.start() + len(m[0]) - len(m[0].lstrip(".")), m.end()
        while end > start and text[end - 1] == ".":
            end -= 1
        if end - start >= 6:
            brute.append((start, end))
    assert list(secrets.candidates(text)) == brute


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=12), st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)),
                                                           max_size=6))
def test_tokens_outside_spans(cuts, spans):
    cuts = sorted(set(cuts))
    tokens = list(zip(cuts[::2], cuts[1::2]))
    spans = sorted((a, a + n) for a, n in spans)
    assert list(secrets.outside(tokens, spans)) == \
        [(a, b) for a, b in tokens if not any(x < b and a < y for x, y in spans)]


def _credential(rng, form):
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    if form == "short":
        return pick(lower + lower.upper() + digits, 10)
    if form == "dotted":
        return ".".join(pick(lower + lower.upper() + digits + "_-", n) for n in (12, 24, 16))
    return pick(lower + digits, 20)


def test_bare_credentials_of_every_form_are_recalled(spark):
    """Learned behind a cue, then met bare: 9 of 10 and more are found; of ordinary
    tokens, none of 3,000 words and at most one in a hundred names with digits."""
    rng = random.Random(8)
    syllables = "the in ter na tion al mis un der stand ing coun ter re vo lu ary com put er ful ly".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 5)))
    forms = ("short", "dotted", "long")
    texts = [(i, " ".join(word() for _ in range(60)) + f" report-{i}.txt of 2024-0{1 + i % 9}-17, "
              f"token={_credential(rng, forms[i % 3])}") for i in range(600)]
    scorer = secrets.Scorer(secrets.fit(documents(spark, texts)))
    for form in forms:
        bare = [_credential(rng, form) for _ in range(300)]
        assert sum(map(scorer.is_secret, bare)) >= 270, form
    assert not any(map(scorer.is_secret, (word() + word() for _ in range(3000))))
    names = [f"report-{rng.randint(0, 999)}.txt" for _ in range(200)] + \
        [f"20{rng.randint(10, 30)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}" for _ in range(200)]
    assert sum(map(scorer.is_secret, names)) <= 4


@pytest.mark.parametrize("token", ["7" * 200_000, "a" * 200_000, "A" * 200_000, "+" * 200_000,
                                   "a" * 100_000 + "B" + "a" * 100_000, "a1" * 100_000, "aB" * 100_000,
                                   "token=" * 40_000, "token" + " " * 200_000])
def test_very_long_tokens_take_linear_time(token):
    import time
    start = time.process_time()
    list(secrets.candidates(token)), list(secrets.base_matches(token))
    assert time.process_time() - start < 1
