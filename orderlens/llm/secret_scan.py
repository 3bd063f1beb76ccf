"""Secret scans: rules for known formats, learned automata for their likes.

Base rules find credentials of three kinds. Their values, found in the whole
corpus, are the labelled credentials; from a bounded sample of the distinct
ones a probabilistic automaton is inferred for each kind by merging states of
the prefix tree whose continuations differ by no more than chance (Hoeffding
bounds), and one for ordinary long tokens. Every other token of ``least`` or
more credential characters is a candidate, whole, also where it reaches beyond
a base match that it touches, and is scored by the likelihood of
its format under the best kind against the ordinary one, by character. It is
a secret if that exceeds what the lowest fiftieth of all labelled credentials
of the corpus reach (cut to ``least`` characters, as short as a candidate may
be), and at least ``MARGIN``.

Unlabelled secrets are among the tokens that the ordinary automaton is inferred
from. Those that a kind explains as well as its own values stay out, and then,
in rounds, those that would be secrets, so a common format without a rule
doesn't count as ordinary. If that would be more than half of the sample, the
labelled values look like ordinary text and all tokens are kept in.

Defined results: null and empty texts have no spans; a kind with fewer than
``MIN_VALUES`` distinct values is not inferred; texts are scanned whole and
independently, so repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orderlens.session import materialize

from .arrays import text_slices

# fixed values: the base rules, in the order in which kinds are listed, and their least lengths
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs [0-9a-f]+ of 24 characters or more
KINDS = ("assign", "access", "hex", "inferred")
MIN_VALUES = 20
MARGIN, ROUNDS = 0.1, 5
STEP, MOST = 0.01, 5000  # to which scores of labelled credentials are rounded, and their most steps
ORDINARY = "ordinary"

_CLASSES = {**{c: "0" for c in "0123456789"}, **{c: "a" for c in "abcdef"}, **{c: "g" for c in "ghijklmnopqrstuvwxyz"},
            **{c: "A" for c in "ABCDEF"}, **{c: "G" for c in "GHIJKLMNOPQRSTUVWXYZ"}}
_TO_CLASS = str.maketrans(_CLASSES)
_SYMBOLS = 12  # five classes, six marks, the end


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base rules' matches, in order."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    out.sort()
    return out


def candidates(text: str, spans: list[tuple[int, int, int, str]], least: int, touching: bool = False) -> list[tuple[int, int]]:
    """Runs of credential characters that touch no base span, and with
    ``touching`` also those that reach beyond the base spans they touch.

    Both lists are in order: one walk through the two."""
    out, k, reached = [], 0, 0  # spans before k begin before the run ends; the furthest of them ends at reached
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]{%d,}" % least, text):
        a, b = m.span()
        inside = a if reached <= a else min(reached, b)  # the run is covered from its start to here
        touched = reached > a
        while k < len(spans) and spans[k][0] < b:
            s, _, e, _ = spans[k]
            if e > a:
                touched = True
                if s <= inside:
                    inside = max(inside, e)
            reached = max(reached, e)
            k += 1
        if not touched or (touching and inside < b):
            out.append((a, b))
    return out


class Automaton:
    """A probabilistic deterministic automaton over character classes."""

    def __init__(self, values: list[str], alpha: float = 0.05):
        self.count, self.final, self.next = [0], [0], [{}]
        for value in values:
            self._add(value.translate(_TO_CLASS))
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()
        self._finish()

    def _add(self, symbols: str) -> None:
        q = 0
        self.count[0] += 1
        for c in symbols:
            edge = self.next[q].get(c)
            if edge is None:
                edge = self.next[q][c] = [len(self.count), 0]
                self.count.append(0)
                self.final.append(0)
                self.next.append({})
            edge[1] += 1
            q = edge[0]
            self.count[q] += 1
        self.final[q] += 1

    def _alike(self, a: int, b: int) -> bool:
        """Whether all continuations of two states agree within chance."""
        open_ = [(a, b)]
        while open_:
            a, b = open_.pop()
            na, nb = self.count[a], self.count[b]
            if not na or not nb:
                continue
            bound = self._bound * (na ** -0.5 + nb ** -0.5)
            if abs(self.final[a] / na - self.final[b] / nb) > bound:
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                ea, eb = self.next[a].get(c), self.next[b].get(c)
                if abs((ea[1] if ea else 0) / na - (eb[1] if eb else 0) / nb) > bound:
                    return False
                if ea and eb:
                    open_.append((ea[0], eb[0]))
        return True

    def _merge(self, into: int, state: int) -> None:
        """Fold a state, the root of a tree, into another."""
        open_ = [(into, state)]
        while open_:
            a, b = open_.pop()
            self.count[a] += self.count[b]
            self.final[a] += self.final[b]
            for c, (child, n) in self.next[b].items():
                edge = self.next[a].get(c)
                if edge is None:
                    self.next[a][c] = [child, n]
                else:
                    edge[1] += n
                    open_.append((edge[0], child))

    def _infer(self) -> None:
        """Merge fringe states into settled ones where alike, else settle them."""
        self.settled = [0]
        fixed = {0}
        while True:
            fringe = [(q, c) for q in self.settled for c, e in sorted(self.next[q].items()) if e[0] not in fixed]
            if not fringe:
                return
            q, c = max(fringe, key=lambda x: self.next[x[0]][x[1]][1])  # the most certain first
            state = self.next[q][c][0]
            for other in self.settled:
                if self._alike(other, state):
                    self.next[q][c][0] = other
                    self._merge(other, state)
                    break
            else:
                self.settled.append(state)
                fixed.add(state)

    def _finish(self) -> None:
        """Smoothed log probabilities; a symbol unseen in a state starts again."""
        number = {q: i for i, q in enumerate(self.settled)}
        self.steps, self.ends, self.unseen = [], [], []
        for q in self.settled:
            total = self.count[q] + 0.1 * _SYMBOLS
            self.steps.append({c: (number[e[0]], math.log((e[1] + 0.1) / total)) for c, e in self.next[q].items()})
            self.ends.append(math.log((self.final[q] + 0.1) / total))
            self.unseen.append(math.log(0.1 / total))
        del self.count, self.final, self.next, self.settled

    def score(self, symbols: str, ended: bool = True) -> float:
        """Log likelihood of a format, or of all that start with it."""
        q, total = 0, 0.0
        for c in symbols:
            step = self.steps[q].get(c)
            q, p = step if step else (0, self.unseen[q])
            total += p
        return total + self.ends[q] if ended else total


def limit_of(steps: dict[int, int]) -> float:
    """The score that all but the lowest fiftieth reach, from counts of steps."""
    left = sum(steps.values()) // 50
    for step in sorted(steps):
        left -= steps[step]
        if left < 0:
            return max(step * STEP, MARGIN)
    return math.inf


class Grammar:
    """The kinds' automata, the ordinary one and the score above which a token is a secret."""

    def __init__(self, values: dict[str, list[str]], least: int = 16):
        labelled = [values[k] for k in KINDS[:3] if len(values.get(k, [])) >= MIN_VALUES]
        self.kinds = [Automaton(v) for v in labelled]
        self.memo: dict[str, float] = {}
        plain = values.get(ORDINARY, [])
        kept = self._unlike(plain, labelled)
        for _ in range(ROUNDS):
            self.ordinary = Automaton(kept)
            self.memo.clear()
            self.limit = limit_of(Counter(self.step(v, least) for own in labelled for v in own))
            next_ = [v for v in kept if self.score(v) <= self.limit]
            if len(next_) == len(kept) or 2 * len(next_) < len(plain):
                break
            kept = next_
        self.memo.clear()

    def _unlike(self, plain: list[str], labelled: list[list[str]]) -> list[str]:
        """The tokens that no kind explains as it does its own values."""
        out = plain
        for kind, own in zip(self.kinds, labelled):
            def by_character(v, kind=kind):
                return kind.score(v.translate(_TO_CLASS), False) / max(1, len(v))
            usual = sorted(map(by_character, own))
            cut = len(usual) // 50
            out = [v for v in out if not usual[cut] <= by_character(v) <= usual[-1 - cut]]
        return out if 2 * len(out) >= len(plain) else plain

    def step(self, value: str, least: int) -> int:
        """A labelled credential's score, as short as a candidate may be, in steps."""
        return max(-MOST, min(MOST, math.floor(self.score(value[:least]) / STEP)))

    def score(self, token: str) -> float:
        """Log likelihood ratio of the best kind against ordinary tokens, by character."""
        if not self.kinds:
            return -math.inf
        symbols = token.translate(_TO_CLASS)
        found = self.memo.get(symbols)
        if found is None:
            found = (max(k.score(symbols) for k in self.kinds) - self.ordinary.score(symbols)) / max(1, len(symbols))
            if len(self.memo) < 100_000 and len(symbols) < 200:
                self.memo[symbols] = found
        return found

    def spans(self, text: str, least: int) -> list[tuple[int, int, int]]:
        """(start, kind number, end) of all secrets, in order."""
        base = base_spans(text)
        out = [s[:3] for s in base]
        if self.kinds:
            more = [(a, 3, b) for a, b in candidates(text, base, least, True) if self.score(text[a:b]) > self.limit]
            if more:
                out = sorted(out + more)
        return out


def _sample(docs: DataFrame, text: str, size: int, least: int, longest: int) -> dict[str, list[str]]:
    """Of each kind, the ``size`` distinct values with the smallest hashes
    (values of more than ``longest`` characters teach nothing about format)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {k: {} for k in (*KINDS[:3], ORDINARY)}

        def note(kind, value):
            if len(value) <= longest:
                mine = held[kind]
                if value not in mine:
                    mine[value] = xxhash.xxh64_intdigest(value.encode()) >> 1
                    if len(mine) >= 4 * size:
                        held[kind] = dict(sorted(mine.items(), key=lambda x: (x[1], x[0]))[:size])
        for b in text_slices(batches, text):
            for t in b.column(0).to_pylist():
                base = base_spans(t or "")
                for _, kind, _, value in base:
                    note(KINDS[kind], value)
                for x, y in candidates(t or "", base, least):
                    note(ORDINARY, t[x:y])
        rows = [(k, v, h) for k, mine in held.items()
                for v, h in sorted(mine.items(), key=lambda x: (x[1], x[0]))[:size]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["kind", "value", "h"])
    # a bounded number of rows from each partition
    found = materialize(docs.select(text).mapInArrow(run, "kind string, value string, h long").distinct())
    return {k: [r["value"] for r in found.where(found["kind"] == k).orderBy("h", "value").limit(size).collect()]
            for k in (*KINDS[:3], ORDINARY)}


def _limit(docs: DataFrame, text: str, grammar: Grammar, least: int, kinds: set[int]) -> float:
    """The limit from the labelled credentials of all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Counter(grammar.step(v, least) for b in text_slices(batches, text) for t in b.column(0).to_pylist()
                        for _, k, _, v in base_spans(t or "") if k in kinds)
        if steps:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*steps.items())], names=["step", "n"])
    # at most 2 * MOST + 1 rows
    counts = docs.select(text).mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))
    return limit_of({r["step"]: r["n"] for r in counts.collect()})


def learn(docs: DataFrame, text: str = "text", sample_values: int = 1000, least: int = 16, longest: int = 128) -> Grammar:
    """Automata from at most ``sample_values`` distinct values of each kind, the limit from all rows."""
    values = _sample(docs, text, sample_values, least, longest)
    grammar = Grammar(values, least)
    if grammar.kinds:
        inferred = {i for i, k in enumerate(KINDS[:3]) if len(values[k]) >= MIN_VALUES}
        grammar.limit = _limit(docs, text, grammar, least, inferred)
        grammar.memo.clear()
    return grammar


def scan(docs: DataFrame, grammar: Grammar, doc_id: str = "doc_id", text: str = "text", least: int = 16) -> DataFrame:
    """(doc_id, spans): all secrets as an array of (kind, start, end), by start, then kind as listed."""
    docs = docs.select(doc_id, text)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])
    schema = T.StructType([docs.schema[doc_id], T.StructField("spans", T.ArrayType(span))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in grammar.spans(t or "", least)]
                     for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, arrow.field("spans").type)], schema=arrow)
    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, grammar: Grammar, text: str = "text", least: int = 16, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret (overlapping spans as one) replaced by ``mask``."""
    schema = docs.schema
    arrow = to_arrow_schema(schema)

    def clean(t):
        if not t:
            return t
        out, at = [], 0
        for s, _, e in grammar.spans(t, least):
            if s >= at:
                out += [t[at:s], mask]
            at = max(at, e)
        return "".join(out) + t[at:] if out else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text):
            at = b.schema.get_field_index(text)
            columns = list(b.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], arrow.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
    return docs.mapInArrow(run, schema)
