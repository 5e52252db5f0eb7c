"""Language identification with string kernels.

Kernel: blended-spectrum presence bits. A text is the set of its character
n-grams (orders 1 to 3, letters lower-cased, everything else one blank); the
kernel of two texts is the number of n-grams they share over the geometric mean
of their set sizes. N-grams are numbered by a hash into ``2 ** BITS`` numbers.

Nyström landmarks: a fixed number of training texts per language. A text is
mapped to its kernel values against the landmarks times the inverse square root
of the landmarks' kernel matrix, in batches as one matrix product. One-versus-
rest kernel ridge regression on these features gives one score per language;
the largest wins, and the softmax of the scores (one temperature, fitted on the
training sample) is the confidence.

Training uses a bounded sample: at most ``PER_LANGUAGE`` documents of each
language, those with the smallest hashes of their doc_id among the rows whose
fold is not the held-out one. Sampled texts are used whole.

Cases: null text or text without a letter: ``und``, score 0. No usable training
row: ``und`` for every text. Rows with a null language are not trained on.
Repeated rows and doc_ids: row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, doc_texts, fold_of, map_stream

ORDERS = (1, 2, 3)
BITS = 18
PER_LANGUAGE = 200
LANDMARKS = 16
RIDGE = 1e-3
BATCH = 256
UNKNOWN = "und"

_HASH = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


_table: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For every code point whether it is a letter; made once per process."""
    if not _table:
        _table["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _table["letters"]


def ngrams(text: str, present: np.ndarray) -> np.ndarray:
    """Distinct n-gram numbers of a text, sorted. ``present`` is scratch space
    (all zero before and after)."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4")
    codes = np.where(_letters()[codes], codes, 32)
    blank = codes == 32
    codes = codes[~(blank & np.r_[False, blank[:-1]])].astype(np.uint64)
    mixed = np.zeros(len(codes), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        if len(codes) < order:
            break
        mixed = mixed[:len(codes) - order + 1] + codes[order - 1:] * _HASH[order - 1]
        if order in ORDERS:
            h = (mixed ^ (mixed >> np.uint64(29))) * _HASH[0]
            present[(h >> np.uint64(64 - BITS)).astype(np.int64)] = 1
    found = np.flatnonzero(present)
    present[found] = 0
    return found


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray      # n-gram numbers of the landmarks, sorted
    landmarks: np.ndarray       # landmarks x vocabulary, presence over root of set size
    projection: np.ndarray      # kernel values -> scores of the languages
    temperature: float = 1.0

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts (n-gram sets) against the landmarks."""
        x = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for i, grams in enumerate(sets):
            at = np.searchsorted(self.vocabulary, grams)
            at[at == len(self.vocabulary)] = 0
            x[i, at[self.vocabulary[at] == grams]] = 1 / np.sqrt(max(len(grams), 1))
        return x @ self.landmarks.T

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        present = np.zeros(1 << BITS, np.uint8)
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        usable = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for k in range(0, len(usable), BATCH):
            part = usable[k:k + BATCH]
            raw = self.kernel([ngrams(texts[i], present) for i in part]) @ self.projection
            soft = np.exp((raw - raw.max(axis=1, keepdims=True)) * self.temperature)
            soft /= soft.sum(axis=1, keepdims=True)
            for i, best, p in zip(part, raw.argmax(axis=1), soft.max(axis=1)):
                languages[i], scores[i] = self.languages[best], float(min(p, 1.0))
        return languages, scores


def train(texts: list[str], labels: list[str], landmarks: int = LANDMARKS,
          ridge: float = RIDGE) -> Model:
    """Nyström features and one-versus-rest ridge regression on a small sample."""
    usable = [(t, label) for t, label in zip(texts, labels) if has_letter(t)]
    languages = sorted({label for _, label in usable})
    if not usable:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32),
                     np.zeros((0, 0), np.float32))
    present = np.zeros(1 << BITS, np.uint8)
    sets = [ngrams(t, present) for t, _ in usable]
    # landmarks: the first of each language in the sample's (random) order
    chosen = [i for lang in languages
              for i in [i for i, (_, label) in enumerate(usable) if label == lang][:landmarks]]
    vocabulary = np.unique(np.concatenate([sets[i] for i in chosen]))
    model = Model(languages, vocabulary, np.zeros((0, len(vocabulary)), np.float32),
                  np.zeros((0, 0), np.float32))
    model.landmarks = np.zeros((len(chosen), len(vocabulary)), np.float32)
    for row, i in enumerate(chosen):
        model.landmarks[row, np.searchsorted(vocabulary, sets[i])] = 1 / np.sqrt(len(sets[i]))
    k = model.kernel(sets).astype(np.float64)
    values, vectors = np.linalg.eigh(k[chosen])
    values = np.maximum(values, 1e-6)
    root = vectors / np.sqrt(values) @ vectors.T
    features = k @ root
    y = np.array([[1.0 if label == lang else -1.0 for lang in languages] for _, label in usable])
    weight = len(usable) / (len(languages) * np.array(
        [sum(label == other for _, other in usable) for _, label in usable]))
    gram = (features.T * weight) @ features + ridge * len(usable) * np.eye(len(chosen))
    solved = np.linalg.solve(gram, (features.T * weight) @ y)
    model.projection = (root @ solved).astype(np.float32)
    raw = features @ solved
    right = [languages.index(label) for _, label in usable]

    def loss(t: float) -> float:
        z = raw * t
        top = z.max(axis=1)
        return float((np.log(np.exp(z - top[:, None]).sum(axis=1)) + top
                      - z[np.arange(len(z)), right]).mean())

    model.temperature = min((0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0), key=loss)
    return model


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``(text, lang)``: of each language the training rows with the smallest
    hashes, about ``per_language`` and never more than twice that."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
        & (fold_of(F.col("doc_id")) != 1))
    counts = {r.lang: r.n for r in rows.select("lang").groupBy("lang")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 13), 16, 10).cast(
        "double") / float(1 << 52)
    wanted = F.lit(False)
    for lang, n in sorted(counts.items()):
        wanted = wanted | ((F.col("lang") == lang) & (share < per_language / n))
    return rows.filter(wanted).select("text", "lang", "doc_id").orderBy(share, "doc_id").limit(
        2 * per_language * max(len(counts), 1)).select("text", "lang")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    rows = training_sample(docs, per_language).collect()
    return train([r.text for r in rows], [r.lang for r in rows])


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)``, one row per row of ``docs``."""
    sent = Sent(docs.sparkSession, model)

    def run(batches):
        for ids, texts in batches:
            yield ids, *sent.value.predict(texts)

    return map_stream(doc_texts(docs), run, "doc_id long, lang_pred string, score double")
