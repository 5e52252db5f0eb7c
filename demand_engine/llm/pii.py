"""Personal data by weak supervision.

Candidates. Patterns of several kinds propose spans in every text: the base
kinds (e-mail, IPv4, card, phone with ``+``), whose matches are always reported,
and looser ones (written-out e-mail, local phone, account number, identity
number, dates after a birth cue, names after a title).

Labelers. Each candidate gets votes (yes, no, abstain) from regular-expression
labelers (does the strict format hold?), gazetteer labelers (cue words, titles
and first names near or in it) and context labelers (what stands next to it).

Aggregation. Spark counts the vote patterns of all candidates of all texts per
kind (a bounded table: kinds x 3 ** labelers at most). Expectation-maximisation
on it estimates each labeler's hit and false-alarm rate and the kind's base rate
(naive-Bayes label model). What is known beforehand of the validator enters as
pseudo-candidates, half as many as the candidates of each class, whatever the size
of the table; its rates are estimated with them like any other's. The expected labels then train the final classifier, a
logistic regression on span features (shape, length, neighbours, cues) whose
patterns Spark counts in the same pass.

Decision. A candidate beyond the base matches is reported if the classifier says
at least ``THRESHOLD`` and no base span overlaps it.

Cases: null or empty text: no spans. Repeated rows and doc_ids: row by row. An
empty table trains nothing and reports nothing. Every pattern runs in time
linear in the text or bounded windows around a trigger, so very long texts and
very long runs of digits or letters are safe.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, column_function, doc_texts, map_stream

THRESHOLD = 0.5
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("email_written", "phone_local", "account", "identity", "birth", "name")
#: Characters on each side of a candidate that context labelers see.
CONTEXT = 32

# --- base matches --------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the base e-mail pattern, leftmost, non-overlapping. A match has
    one ``@`` between a run of local characters and a dotted domain, so it is
    enough to look at each ``@`` once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """``(kind, start, end, holds)`` of every base pattern match; those that do
    not hold (octets, checksum, number of digits) are only candidates."""
    for start, end in emails(text):
        yield "email", start, end, True
    if not _HAS_DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        holds = all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
        yield "ip", m.start(), m.end(), holds
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = _digits(m[0])
        if len(digits) >= 13:
            yield "card", m.start(), m.end(), len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15


# --- further candidates -----------------------------------------------------------

# Cue words, titles and first names of the gazetteer labelers.
CUES = {
    "email": "mail email e-mail correo courriel contact kontakt contacto",
    "ip": "ip host server address addr from client login adresse",
    "card": "card visa mastercard amex credit debit karte tarjeta carte payment",
    "phone": "phone tel call mobile fax cell telefon telefono teléfono téléphone handy ring",
    "email_written": "mail email e-mail correo courriel contact kontakt contacto",
    "phone_local": "phone tel call mobile fax cell telefon telefono teléfono téléphone handy ring",
    "account": "iban account konto cuenta compte bank bic swift",
    "identity": "ssn social security passport ausweis dni nif identity id",
    "birth": "born birth birthday dob geboren né née nacido nacida",
    "name": "name named called mr mrs ms dr herr frau monsieur madame señor señora signed",
}
FIRST_NAMES = frozenset(
    "james mary john linda robert susan michael anna david maria thomas laura peter julia paul "
    "emma daniel sofia carlos elena pierre claire hans petra jean marie jose carmen luis lucia "
    "karl eva stefan nina martin sarah alice george henry alan".split())
AGAINST = frozenset("version ver v release build page section chapter order invoice isbn sku "
                    "price total figure table line".split())
_CUES = {kind: frozenset(words.split()) for kind, words in CUES.items()}

_WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{2,64})\s?(?:\(at\)|\[at\]|\sat\s)\s?"
                      r"([A-Za-z0-9-]{2,64}(?:\s?(?:\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z0-9-]{2,64}){1,4})")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")
_IDENTITY = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_DATE = re.compile(r"(?<![\w./-])[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}(?![\w/-])")
_TITLES = ("Mr", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20"
                   r"([A-ZÀ-Þ][a-zß-ÿ]{1,30}(?:\x20[A-ZÀ-Þ][a-zß-ÿ]{1,30}){0,2})")
_HAS_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[\w-]+")


def iban_holds(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def more_candidates(text: str) -> Iterator[tuple[str, int, int, bool]]:
    if "dot" in text:
        for m in _WRITTEN.finditer(text):
            yield "email_written", m.start(), m.end(), "dot" in m[2]
    if _HAS_DIGIT.search(text):
        for m in _LOCAL_PHONE.finditer(text):
            yield "phone_local", m.start(), m.end(), True
        for m in _ACCOUNT.finditer(text):
            yield "account", m.start(), m.end(), iban_holds(m[0])
        for m in _IDENTITY.finditer(text):
            yield "identity", m.start(), m.end(), m[0][:3] not in ("000", "666") and m[0][0] != "9"
        for m in _DATE.finditer(text):
            before = _WORD.findall(text[max(0, m.start() - CONTEXT):m.start()])
            if not _CUES["birth"] & {w.lower() for w in before}:
                continue
            parts = [int(p) for p in re.split(r"[./-]", m[0])]
            yield "birth", m.start(), m.end(), any(1900 <= p <= 2030 for p in parts)
    for m in _NAME.finditer(text) if any(t in text for t in _TITLES) else ():
        yield "name", m.start(1), m.end(1), True


# --- labelers ------------------------------------------------------------------------

LABELERS = ("validator", "cue_near", "cue_adjacent", "gazetteer", "against", "neighbours", "grouping",
            "variety")


#: Kinds whose format can be proved wrong (checksum, range, number of digits).
VALIDATED = frozenset(("ip", "card", "phone", "account", "identity", "birth"))
#: Vote rates of the validator (no, abstain, yes) that are expected beforehand, without
#: and with personal data (a random candidate passes about one time in ten), and the
#: weight of this expectation against the candidates' own votes.
VALIDATOR_SHARE = 0.5
VALIDATOR = np.array([[0.88, 0.02, 0.10], [0.01, 0.02, 0.97]])


def votes(kind: str, text: str, start: int, end: int, holds: bool) -> tuple[int, ...]:
    """One vote per labeler: 1 yes, -1 no, 0 abstain."""
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    words = [w.lower() for w in _WORD.findall(before)]
    near = set(words) | {w.lower() for w in _WORD.findall(after)}
    cues = _CUES[kind]
    digits = _digits(span)
    left, right = before[-1:], after[:1]
    return (
        (1 if holds else -1) if kind in VALIDATED else 0,
        1 if near & cues else 0,
        1 if words and words[-1] in cues else 0,
        (1 if {w.lower() for w in _WORD.findall(span)} & FIRST_NAMES else 0)
        if kind in ("name", "email", "email_written") else 0,
        -1 if words and words[-1] in AGAINST else 0,
        -1 if left.isalnum() or right.isalnum() or left in ("#", "/") else 1,
        (1 if re.search(r"[\x20().-]", span) else 0) if kind in ("card", "phone", "phone_local",
                                                                 "account") else 0,
        -1 if digits and len(set(digits)) <= 2 and len(digits) > 6 else 0,
    )


FEATURES = ("holds", "cue", "adjacent", "clean_left", "clean_right", "long", "grouped", "varied",
            "against")


def features(kind: str, text: str, start: int, end: int, holds: bool) -> tuple[int, ...]:
    """Binary features of the final span classifier (its own view of the span)."""
    v = votes(kind, text, start, end, holds)
    left, right = text[start - 1:start] if start else "", text[end:end + 1]
    return (int(holds), int(v[1] > 0), int(v[2] > 0), int(not left or left.isspace()),
            int(not right or right.isspace() or right in ",.;:"), int(end - start > 12),
            int(v[6] > 0), int(v[7] == 0), int(v[4] < 0))


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    return [*base_matches(text), *more_candidates(text)]


# --- label model and classifier -------------------------------------------------------

@dataclass
class Model:
    """Per kind: weights of the span classifier (bias first); and, for reports,
    the labelers' estimated hit and false-alarm rates."""
    weights: dict[str, list[float]] = field(default_factory=dict)
    reliability: dict[str, dict[str, tuple[float, float]]] = field(default_factory=dict)

    def probability(self, kind: str, x: tuple[int, ...]) -> float:
        w = self.weights.get(kind)
        if w is None:
            return 0.0
        return 1 / (1 + math.exp(-(w[0] + sum(a * b for a, b in zip(w[1:], x)))))


def estimate(patterns: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of the label model.

    ``patterns``: distinct vote rows, ``n``: how often each occurs. Returns the
    chance that a row with each pattern is personal data, and the vote
    distributions ``[labeler, class, vote + 1]``. Starts from the majority vote, the
    validator's counted three times. A few pseudo-candidates per class and vote, tilted
    to labelers that are better than chance, keep every estimate inside the open
    interval; the validator (labeler 0) has ``VALIDATOR_SHARE`` of each class more."""
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    prior = np.tile(np.array([[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]]), (patterns.shape[1], 1, 1))
    post = 1 / (1 + np.exp(-patterns.sum(axis=1) - 2 * patterns[:, 0]))
    for _ in range(rounds):
        soft = np.stack([(1 - post) * n, post * n])                      # class x pattern
        table = np.einsum("cp,plv->lcv", soft, one_hot) + prior
        table[0] += VALIDATOR_SHARE * soft.sum(axis=1)[:, None] * VALIDATOR
        table /= table.sum(axis=2, keepdims=True)
        rate = (soft[1].sum() + 1) / (n.sum() + 2)
        log = np.einsum("plv,lcv->cp", one_hot, np.log(table))
        new = 1 / (1 + np.exp(np.clip(log[0] + math.log(1 - rate) - log[1] - math.log(rate), -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, table


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression on soft labels (Newton steps, halved while
    they would raise the loss)."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return float(n @ (np.logaddexp(0, z) - y * z) + w @ w / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + w
        hessian = (x.T * (n * p * (1 - p) + 1e-9)) @ x + np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        while np.abs(step).max() >= 1e-8 and loss(w - step) > loss(w):
            step /= 2
        if np.abs(step).max() < 1e-8:
            break
        w -= step
    return w


def fit(docs: DataFrame) -> Model:
    """Labeler reliabilities and span classifier from all texts."""
    def run(batches):
        for (texts,) in batches:
            found: dict[tuple, int] = {}
            for text in texts:
                for kind, start, end, holds in candidates(text):
                    key = (kind, votes(kind, text, start, end, holds),
                           features(kind, text, start, end, holds))
                    found[key] = found.get(key, 0) + 1
            yield ([k[0] for k in found], [list(k[1]) for k in found], [list(k[2]) for k in found],
                   list(found.values()))

    counted = (map_stream(doc_texts(docs).select("text"), run,
                          "kind string, votes array<int>, features array<int>, n long")
               .groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).collect())
    model = Model()
    for kind in sorted({r.kind for r in counted}):
        mine = sorted((tuple(r.votes), tuple(r.features), r.n) for r in counted if r.kind == kind)
        n = np.array([m[2] for m in mine], float)
        post, table = estimate(np.array([m[0] for m in mine]), n)
        model.weights[kind] = logistic(np.array([m[1] for m in mine], float), post, n).tolist()
        model.reliability[kind] = {name: (float(table[i, 1, 2]), float(table[i, 0, 2]))
                                   for i, name in enumerate(LABELERS)}
    return model


# --- spans ---------------------------------------------------------------------------

def find(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and further spans of one text, each by kind, then start."""
    base, more = [], []
    for kind, start, end, holds in candidates(text):
        if holds and kind in BASE_KINDS:
            base.append((kind, start, end))
        elif model.probability(kind, features(kind, text, start, end, holds)) >= THRESHOLD:
            more.append((kind, start, end))
    return base, [m for m in more if not any(a < m[2] and m[1] < b for _, a, b in base)]


_ORDER = {kind: i for i, kind in enumerate((*BASE_KINDS, *MORE_KINDS))}


def joined(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (_ORDER[s[0]], s[1]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def find_all(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, base, spans)``: base spans and all spans of each row's text,
    ``kind:start:end`` in code points, end exclusive."""
    sent = Sent(docs.sparkSession, model)

    def run(batches):
        for ids, texts in batches:
            found = [find(t, sent.value) for t in texts]
            yield ids, [joined(b) for b, _ in found], [joined([*b, *m]) for b, m in found]

    return map_stream(doc_texts(docs), run, "doc_id long, base string, spans string")


def redact(text: str, model: Model) -> str:
    """The text with every span replaced by its kind in brackets; overlapping
    spans become one, named by the first."""
    base, more = find(text, model)
    out, done = [], 0
    for kind, start, end in sorted([*base, *more], key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with redacted texts (null stays null) and, where the column is
    there, their new ``n_chars``."""
    sent = Sent(docs.sparkSession, model)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redact(t, sent.value))

    out = docs.withColumn("text", column_function(run, "string")("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text")).cast(kind))
    return out

