"""Toxicity scoring behind a noisy-channel deobfuscation.

Language model: character trigrams counted over the texts of all documents
(26 letters, one class for other letters, word boundary).

Channel: a token that carries noise (digits or symbols, a letter repeated three
times or more, letters spaced out one by one, with or without marks between
them) is turned into a lattice: each character stands for itself, for the letters
it is used for, for a word break or for nothing, each at a fixed cost. Viterbi
decoding over the lattice under the language model restores the most likely text,
whatever the token's length and however few plain letters it has (so a number is
read as letters too; whether such a word is evidence is learned like any other).
The parts of a token between marks that stand for no letter count as words beside
its decoding, so words joined by ``_``, ``.`` or ``-`` are not lost.
Tokens without noise have a lattice of one path and are left as they are.

Scoring: the labelled documents (a bounded sample, one of each set of documents
with the same smallest shingle hash, so that copies do not vote twice) give each
restored word and word beginning a count of toxic and of other documents.
Evidence is kept if its toxic share could not come from the base rate by chance
among all candidates (binomial tail, Bonferroni) and is at least
``MIN_PRECISION``. A logistic regression on the strength, number and density of
a text's evidence, trained on the same documents, gives the score.

Cases: null or empty text: no words, the score of a text without evidence.
Labels that are null are not used; a document labelled twice counts twice.
No usable label: no evidence, every score is low. Very long texts are scored
whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (Sent, column_function, doc_texts, fold_of, map_stream, materialize,
                     tidy)

#: Labelled documents that the evidence is learned from, at most.
SAMPLE = 10_000
THRESHOLD = 0.7
MIN_PRECISION = 0.5
SIGNIFICANCE = 0.01
#: Lengths of word beginnings that count as evidence beside the whole word.
BEGINNINGS = (4, 5, 6, 7)
CACHE = 100_000
#: Longer tokens are decoded each time they are met, not remembered.
REMEMBERED = 40

# Letters that a character is commonly written for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t",
              "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
              "£": "l", "(": "c", "¡": "i", "*": "aeiou"}
# Costs (negative log probabilities) of the channel.
COST_SUBSTITUTE, COST_DROP, COST_BREAK, COST_SPACED = 0.7, 1.5, 2.5, 0.3
COST_DIGIT_LOST, COST_SINGLE, COST_DOUBLE = 10.0, 2.0, 0.5

_SYMBOLS = 28  # boundary 0, a-z 1..26, other letters 27
_EDGE = ".,;:?\"'`´’‘“”«»()[]{}<>…"
_PLAIN_EDGE = _EDGE + "!*#&%$@~^=+|/\\-_"
_CODE = np.zeros(256, np.int64)
for _c in range(256):
    _ch = bytes([_c]).decode("latin-1")
    _CODE[_c] = _c - 96 if "a" <= _ch <= "z" else 27 if _ch.isalpha() else 0
_CODE[0x7F] = 27  # stands for letters beyond Latin-1


def _codes(text: str) -> np.ndarray:
    """Symbol of each character of a lower-case text."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        raw = re.sub(r"[^\x00-\xff]", lambda m: "\x7f" if m[0].isalpha() else " ",
                     text).encode("latin-1")
    return _CODE[np.frombuffer(raw, np.uint8)]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts, as a cube of 28 symbols a side."""
    def run(batches):
        for (texts,) in batches:
            total = np.zeros(_SYMBOLS ** 3, np.int64)
            for text in texts:
                c = np.concatenate([[0], _codes(text.lower()), [0]])
                c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]  # one boundary between words
                if len(c) > 2:
                    total += np.bincount((c[:-2] * _SYMBOLS + c[1:-1]) * _SYMBOLS + c[2:],
                                         minlength=len(total))
            seen = np.flatnonzero(total)
            yield seen, total[seen]

    counts = map_stream(doc_texts(docs).select("text"), run, "trigram int, n long")
    cube = np.zeros(_SYMBOLS ** 3, np.float64)  # at most 28 ** 3 rows come back
    for r in counts.groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        cube[r.trigram] = r.n
    return cube.reshape((_SYMBOLS,) * 3)


def language_model(cube: np.ndarray) -> np.ndarray:
    """``-log P(c | a, b)``, trigrams interpolated with bigrams and single symbols."""
    one = cube.sum(axis=(0, 1)) + 0.5
    one /= one.sum()
    pairs = cube.sum(axis=0)
    two = (pairs + 5 * one) / (pairs.sum(axis=1, keepdims=True) + 5)
    three = (cube + 5 * two) / (cube.sum(axis=2, keepdims=True) + 5)
    return -np.log(three)


def _symbol(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


def _readings(ch: str, n: int) -> list[tuple[str, float]]:
    """The readings of ``n`` (3: or more) equal characters, with their costs."""
    if ch.isalpha():
        return ([(ch, 0.0)] if n == 1 else [(ch * 2, 0.0), (ch, COST_SINGLE)] if n == 2
                else [(ch, 0.0), (ch * 2, COST_DOUBLE)])
    lost = COST_DIGIT_LOST if ch.isdigit() else 0.0
    readings = [("", COST_DROP + lost), (" ", COST_BREAK + lost)]
    for letter in STANDS_FOR.get(ch, ""):
        readings.append((letter, COST_SUBSTITUTE))
        if n > 1:
            readings.append((letter * 2, COST_SUBSTITUTE + (n > 2) * COST_DOUBLE))
    return readings


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """The readings of each run of equal characters, with their costs."""
    runs = [(ch, min(sum(1 for _ in run), 3)) for ch, run in groupby(token)]
    readings = {run: _readings(*run) for run in set(runs)}
    return [readings[run] for run in runs]


def viterbi(columns: Iterable[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The cheapest path through a lattice under the character model. Paths are
    chains of back-pointers that share their beginnings: time and memory are
    linear in the number of columns."""
    states = {(0, 0): (0.0, None)}
    for readings in chain(columns, [[(" ", 0.0)]]):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for out, extra in readings:
                x, y, total = a, b, cost + extra
                for ch in out:
                    s = _symbol(ch)
                    if s or y:  # no second boundary in a row
                        total += model.item(x, y, s)
                        x, y = y, s
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = total, (path, out) if out else path
        states = after
    lowest = min(cost for cost, _ in states.values())
    return min(_spelled(path) for cost, path in states.values() if cost == lowest).strip()


def _spelled(path: tuple | None) -> str:
    outs = []
    while path:
        path, out = path
        outs.append(out)
    return "".join(reversed(outs))


_REPEATED = re.compile(r"([^\W\d_])\1\1")
_JOINT = re.compile("(?:[^\\w'’`´" + re.escape("".join(STANDS_FOR)) + "]|_)+")


class Restorer:
    """Words of a text with the noise taken out; remembers tokens it has seen."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.seen: dict[str, tuple[str, ...]] = {}

    def token(self, token: str) -> tuple[str, ...]:
        if token.isalpha() and not _REPEATED.search(token):
            return (token,)
        core = token.strip(_EDGE)
        if core.isalpha() and not _REPEATED.search(core):
            return (core,)
        plain = core.strip(_PLAIN_EDGE)
        if plain.isalpha() and not _REPEATED.search(plain) and len(plain) > 2:
            # decoration at the edges, or a letter written as a symbol there
            noisy = core.strip("*#&%~^=/\\-_+")
            if noisy == plain or len(set(core.removeprefix(plain))) == 1 and len(core) > len(plain) + 1:
                return (plain,)
            core = noisy
        restored = Counter(viterbi(lattice(core), self.model).split())
        parts = _JOINT.split(core)
        if len(parts) > 1 and max(map(len, parts)) > 1:  # words joined by marks, perhaps
            restored |= Counter(w for part in parts if part for w in self.token(part))
        if plain.isalpha():
            restored |= Counter([plain])
        return tuple(restored.elements())

    def words(self, text: str) -> Counter[str]:
        if len(self.seen) > CACHE:
            self.seen.clear()
        seen, found = self.seen, Counter()
        tokens = text.lower().split()
        for token, n in Counter(tokens).items():
            words = seen.get(token)
            if words is None:
                words = self.token(token)
                if len(token) <= REMEMBERED:
                    seen[token] = words
            for word in words:
                found[word] += n
        spaced: list[str] = []
        letters = 0
        for token in [*tokens, ""]:
            core = token.strip(_EDGE + "*-_")
            if len(core) == 1 and len(token) < 4:
                spaced.append(core)
                letters += 1
            elif token and not core:  # marks alone do not end a run
                if spaced:
                    spaced.append(token)
            elif spaced:
                if letters > 2:
                    columns = (c for part in spaced for c in
                               ([("", 0.0), (" ", COST_SPACED)], *lattice(part)))
                    found.update(viterbi(columns, self.model).split())
                spaced, letters = [], 0
        return found


def evidence_of(word: str) -> list[str]:
    return [f"={word}", *[word[:n] for n in BEGINNINGS if len(word) >= n]]


def _sketch_key(text: str) -> int:
    """Smallest hash of the text's 3-word shingles: equal for most near copies."""
    words = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i:i + 3])) >> 1
                for i in range(max(len(words) - 2, 1))), default=0)


@dataclass
class Model:
    characters: np.ndarray
    evidence: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.6, 0, 0, 0, 0]))

    def signs(self, words: Counter[str], known: dict[str, float]) -> list[float]:
        """What the regression sees: any evidence, its strength, number, density."""
        strength, n = 0.0, 0
        for word, count in words.items():
            p = known.get(word)
            if p is None:
                p = known[word] = max(self.evidence.get(e, 0.0) for e in evidence_of(word))
            if p:
                strength += min(math.log(p / (1 - p)), 5.0)
                n += count
        if not n:
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        return [1.0, 1.0, strength, math.log1p(n), math.log1p(1000 * n / words.total())]

    def score(self, words: Counter[str], known: dict[str, float]) -> float:
        z = float(np.dot(self.weights, self.signs(words, known)))
        return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))


def _regression(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 0.1)
    ridge[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge),
                               x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _tail(k: int, n: int, p: float) -> float:
    """Log of the chance (Chernoff bound) of ``k`` or more of ``n`` at rate ``p``."""
    share = k / n
    if share <= p:
        return 0.0
    other = (1 - share) * math.log((1 - share) / (1 - p)) if share < 1 else 0.0
    return -n * (share * math.log(share / p) + other)


def sample_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, toxic)`` of the training fold, at most ``sample`` rows (those
    with the smallest hash of the doc_id)."""
    return (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                          & (fold_of(F.col("doc_id")) != 1))
            .select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.col("toxic").cast("int").alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    model = Model(language_model(trigram_counts(docs)))
    characters = spark.sparkContext.broadcast(model.characters)  # 28 ** 3 numbers
    chosen = spark.createDataFrame(sample_labels(labels, sample).collect(),
                                   "doc_id long, toxic int")
    texts = doc_texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")

    def run(batches):
        restore = Restorer(characters.value)
        for columns in batches:
            for at in range(0, len(columns[0]), 25):  # a text's evidence is larger than the text
                ids, batch, toxic = (c[at:at + 25] for c in columns)
                words = [restore.words(t) for t in batch]
                yield ([_sketch_key(t) for t in batch], ids, toxic,
                       [sorted({e for w in found for e in evidence_of(w)}) for found in words],
                       [list(found.elements()) for found in words])

    votes = map_stream(texts, run, "key long, doc_id long, toxic int, evidence array<string>, "
                                   "words array<string>")
    one = materialize(votes.groupBy("key").agg(
        F.min(F.struct("doc_id", "toxic", "evidence", "words")).alias("d")).select("d.*"))
    counts = one.select(F.explode(F.concat("evidence", F.array(F.lit("")))).alias("e"), "toxic")
    counts = counts.groupBy("e").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("toxic"),
                                     F.count(F.lit(1)).alias("n"))
    total = counts.filter("e = ''").first()
    if total is None or not total.toxic:
        return model
    rate = min(total.toxic / total.n, 0.99)
    candidates = materialize(counts.filter("n >= 3 AND e <> ''"))
    limit = math.log(SIGNIFICANCE / max(candidates.count(), 1))
    strong = candidates.filter(F.col("toxic") >= MIN_PRECISION * F.col("n")).collect()
    model.evidence = {r.e: (r.toxic + 0.5) / (r.n + 1) for r in strong
                      if (r.toxic + 0.5) / (r.n + 1) >= MIN_PRECISION
                      and _tail(r.toxic, r.n, rate) < limit}
    known: dict[str, float] = {}
    rows = one.select("toxic", "words").toLocalIterator()  # at most ``sample`` of them
    signs, marks = zip(*[(model.signs(Counter(r.words), known), float(r.toxic == 1)) for r in rows])
    model.weights = _regression(np.array(signs), np.array(marks))
    return model


def scorer(docs: DataFrame, model: Model):
    """A column function: text -> score from 0 to 1."""
    sent = Sent(docs.sparkSession, model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, known = sent.value, {}
        restore = Restorer(model.characters)
        for texts in batches:
            if len(known) > CACHE:
                known.clear()
            yield pd.Series([model.score(restore.words(t or ""), known) for t in texts],
                            dtype="float64")
        sent.forget()
        model = known = restore = texts = None
        tidy()

    return column_function(run, "double")


def toxic_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, score)``, one row per row of ``docs``."""
    score = scorer(docs, fit(docs, labels, sample))
    return doc_texts(docs).select("doc_id", score("text").alias("score"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    score = scorer(docs, fit(docs, labels))
    return docs.filter(score(F.coalesce(F.col("text"), F.lit(""))) < threshold)
