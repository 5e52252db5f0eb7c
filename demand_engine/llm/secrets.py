"""Secrets by grammar inference.

Base matches: assignments to password-like names, access keys, long hex runs;
those that hold are always reported.

Grammar. The distinct credentials among the base matches are the labelled
examples of their kind (a bounded sample: the ``EXAMPLES`` with the smallest
hashes among those of at most ``MAX_LENGTH`` characters). Their prefix tree, over
character classes, is folded into a probabilistic automaton by merging states whose
outgoing frequencies are statistically compatible (Hoeffding bounds, recursively;
ALERGIA). A background automaton (one state per preceding class) is estimated from
the classes of all candidates of all documents outside base matches.

Decision. Candidates are all runs of credential characters, of the examples' least
length or more, full stops at their ends aside; no shape is excluded. Each is scored
by every kind's automaton against the background. It is reported as ``format``,
unless a base span overlaps it, if for some kind (1) the likelihood ratio outweighs
the odds against a credential, which are counted: candidates in the corpus for each
match of the kind; and (2) the log ratio per character reaches the threshold
learned as the second percentile of the examples' own ratios. An ordinary word is
as likely under the background, so it fails the first; a short credential whose
classes many words share cannot be told by its format and fails it too.

Cases: null or empty text: no spans. Too few examples of a kind (fewer than
``FEWEST``): no grammar of that kind. Repeated rows: row by row. All patterns are
linear in the text, whatever the length of its tokens.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, doc_texts, map_stream, materialize

BASE_KINDS = ("assign", "access", "hex")
MORE_KIND = "format"
EXAMPLES = 1000
FEWEST = 8
ALPHA = 0.05
MIN_LENGTH = 6
MAX_LENGTH = 512
#: Class strings whose verdict a task remembers, and their length, at most.
CACHE = 100_000
REMEMBERED = 64

_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                     r"([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{%d,}+" % (MIN_LENGTH - 1))


def base_matches(text: str) -> Iterator[tuple[str, int, int, str]]:
    """``(kind, start, end, credential)`` of every base match that holds."""
    for m in _ASSIGN.finditer(text) if ":" in text or "=" in text else ():
        if len(m[1]) >= 6:
            yield "assign", m.start(), m.end(), m[1]
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            yield "access", m.start(), m.end(), m[0]
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end(), m[0]


def candidates(text: str) -> Iterator[tuple[int, int]]:
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        if text[end - 1] == ".":
            end = start + len(m[0].rstrip("."))
            if end - start < MIN_LENGTH:
                continue
        yield start, end


class _Classes(dict):
    def __missing__(self, c: int) -> str:
        return "o"


_CLASS = _Classes()
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = ("d" if _ch.isdigit() else "x" if _ch in "abcdef" else "l" if _ch.islower()
                  else "U" if _ch.isupper() else _ch if _ch in "+/_=-." else "o")


def classes(token: str) -> str:
    """One class per character: digits, hex letters, other letters, marks."""
    return token.translate(_CLASS)


def outside(tokens: Iterable[tuple[int, int]], spans: list[tuple[int, int]]
            ) -> Iterator[tuple[int, int]]:
    """The tokens that no span overlaps; both in ascending order of their start."""
    at, reach, latest = 0, 0, len(spans)
    for start, end in tokens:
        while at < latest and spans[at][0] < end:
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= start:
            yield start, end


class Automaton:
    """A probabilistic automaton learned from strings by state merging."""

    def __init__(self, counted: dict[str, int], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        for string, n in sorted(counted.items()):
            at = 0
            for ch in string:
                self.count[at][ch] = self.count[at].get(ch, 0) + n
                if ch not in self.next[at]:
                    self.next[at][ch] = self._new()
                at = self.next[at][ch]
            self.ends[at] += n
        self._merge(alpha)

    def _new(self) -> int:
        self.next.append({})
        self.count.append({})
        self.ends.append(0)
        return len(self.next) - 1

    def total(self, s: int) -> int:
        return self.ends[s] + sum(self.count[s].values())

    def _differs(self, a: int, n: int, b: int, m: int, alpha: float) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return abs(a / n - b / m) > bound

    def _compatible(self, a: int, b: int, alpha: float) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            if self._differs(self.ends[a], n, self.ends[b], m, alpha):
                return False
            for ch in self.count[a].keys() | self.count[b].keys():
                if self._differs(self.count[a].get(ch, 0), n, self.count[b].get(ch, 0), m, alpha):
                    return False
                if ch in self.next[a] and ch in self.next[b] and self.next[a][ch] != self.next[b][ch]:
                    stack.append((self.next[a][ch], self.next[b][ch]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to the states from ``a`` on."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.ends[a] += self.ends[b]
            for ch, n in self.count[b].items():
                self.count[a][ch] = self.count[a].get(ch, 0) + n
                if ch in self.next[a]:
                    if self.next[a][ch] != self.next[b][ch]:
                        stack.append((self.next[a][ch], self.next[b][ch]))
                else:
                    self.next[a][ch] = self.next[b][ch]

    def _merge(self, alpha: float) -> None:
        red = [0]
        blue = [(0, ch) for ch in sorted(self.next[0])]
        while blue:
            parent, ch = blue.pop(0)
            state = self.next[parent][ch]
            if state in red:
                continue
            for known in red:
                if self._compatible(known, state, alpha):
                    self.next[parent][ch] = known
                    self._fold(known, state)
                    break
            else:
                red.append(state)
            blue = [(s, c) for s in red for c in sorted(self.next[s]) if self.next[s][c] not in red]
        keep = {s: i for i, s in enumerate(red)}
        self.next = [{c: keep[t] for c, t in self.next[s].items()} for s in red]
        self.count = [self.count[s] for s in red]
        self.ends = [self.ends[s] for s in red]

        self.known: dict[tuple[int, str], tuple[float, int]] = {}

    def _step(self, at: int, ch: str) -> tuple[float, int]:
        """Natural log of the probability of a class (``$``: the end) in a state,
        smoothed for classes never seen there, and the state after it."""
        n = sum(self.count[at].values()) + self.ends[at]
        seen = self.ends[at] if ch == "$" else self.count[at].get(ch, 0)
        step = math.log((seen + 0.01) / (n + 0.13)), self.next[at].get(ch, 0)
        self.known[at, ch] = step
        return step

    def log_likelihood(self, string: str) -> float:
        """Natural log of the probability of the string."""
        at, total, known = 0, 0.0, self.known
        for ch in string + "$":
            log, at = known.get((at, ch)) or self._step(at, ch)
            total += log
        return total


@dataclass
class Model:
    automata: dict[str, Automaton] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    #: Log of the candidates there are for each match of the kind.
    odds: dict[str, float] = field(default_factory=dict)
    #: Log of the chance of a class after another, by the two of them.
    background: dict[str, float] = field(default_factory=dict)

    def _ratio(self, automaton: Automaton, string: str) -> float:
        known, unseen = self.background, math.log(1e-3)
        base = sum(known.get(a + b, unseen) for a, b in zip("^" + string, string + "$"))
        return (automaton.log_likelihood(string) - base) / (len(string) + 1)

    def is_secret(self, token: str) -> bool:
        return self.has_format(classes(token))

    def has_format(self, string: str) -> bool:
        """The verdict on a token of these classes."""
        for kind, automaton in self.automata.items():
            ratio = self._ratio(automaton, string)
            if ratio >= self.thresholds[kind] and ratio * (len(string) + 1) >= self.odds[kind]:
                return True
        return False


class Scorer:
    """A model's verdict on tokens; remembers the class strings it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.seen: dict[str, bool] = {}

    def is_secret(self, token: str) -> bool:
        string = token.translate(_CLASS)
        verdict = self.seen.get(string)
        if verdict is None:
            verdict = self.model.has_format(string)
            if len(string) <= REMEMBERED:
                if len(self.seen) >= CACHE:
                    self.seen.clear()
                self.seen[string] = verdict
        return verdict


def _shapes(docs: DataFrame) -> DataFrame:
    """``(kind, what, n)``: credentials of each kind, and transitions of classes
    in candidates (kind ``''``; ``^`` before the first, ``$`` after the last)."""
    def run(batches):
        for (texts,) in batches:
            found: Counter[tuple[str, str]] = Counter()
            strings: Counter[str] = Counter()
            for text in texts:
                spans = []
                for kind, start, end, credential in base_matches(text):
                    found[kind, credential] += 1
                    spans.append((start, end))
                shape = classes(text)
                strings.update(shape[a:b] for a, b in outside(candidates(text), sorted(spans)))
            for string, n in strings.items():
                for pair in zip("^" + string, string + "$"):
                    found["", "".join(pair)] += n
            yield [k for k, _ in found], [w for _, w in found], list(found.values())

    return (map_stream(doc_texts(docs).select("text"), run, "kind string, what string, n long")
            .groupBy("kind", "what").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, examples: int = EXAMPLES) -> Model:
    shapes = materialize(_shapes(docs))
    model = Model()
    pairs = {r.what: r.n for r in shapes.filter("kind = ''").collect()}  # classes squared
    for last in {p[0] for p in pairs}:
        total = sum(n for p, n in pairs.items() if p[0] == last) + 13
        for c in "dxlU+/_=-.o$":
            model.background[last + c] = math.log((pairs.get(last + c, 0) + 1) / total)
    seen = sum(n for p, n in pairs.items() if p[0] == "^")
    matches = {r.kind: r.n for r in shapes.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    for kind in BASE_KINDS:
        sample = (shapes.filter((F.col("kind") == kind) & (F.length("what") <= MAX_LENGTH))
                  .orderBy(F.xxhash64("what"), "what").limit(examples).collect())
        if len(sample) < FEWEST:
            continue
        counted: dict[str, int] = {}
        for r in sample:  # a credential counts once, however often it was copied
            counted[classes(r.what)] = counted.get(classes(r.what), 0) + 1
        model.automata[kind] = Automaton(counted)
        model.odds[kind] = math.log(max(seen / matches[kind], 1.0))
        ratios = sorted(model._ratio(model.automata[kind], classes(r.what)) for r in sample)
        model.thresholds[kind] = max(ratios[len(ratios) // 50], 0.1)
    return model


def find(text: str, scorer: Scorer) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = sorted(((k, a, b) for k, a, b, _ in base_matches(text)),
                  key=lambda s: (s[1], BASE_KINDS.index(s[0])))
    tokens = outside(candidates(text), [(a, b) for _, a, b in base]) if base else candidates(text)
    more = [(MORE_KIND, a, b) for a, b in tokens if scorer.is_secret(text[a:b])]
    return base, more


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {kind: i for i, kind in enumerate((*BASE_KINDS, MORE_KIND))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]])))


def find_all(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, base, spans)``: base spans and all spans of each row's text,
    ``kind:start:end`` in code points, end exclusive, by start."""
    sent = Sent(docs.sparkSession, model)

    def run(batches):
        scorer = Scorer(sent.value)
        for ids, texts in batches:
            found = [find(t, scorer) for t in texts]
            yield ids, [joined(b) for b, _ in found], [joined([*b, *m]) for b, m in found]

    return map_stream(doc_texts(docs), run, "doc_id long, base string, spans string")
