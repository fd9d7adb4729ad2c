"""Secret scans: base patterns, and formats learnt from them by grammar inference.

Base patterns find labelled credentials in every whole text. From a bounded sample of them
(`LABELLED` distinct values of each kind, those of the least hashes) ALERGIA infers one
probabilistic automaton a kind: a prefix tree with counts, whose states are merged, least
strings first, as long as their ending and branching frequencies are compatible by Hoeffding
bounds, recursively. Then all candidates (runs of credential characters outside the base
spans) are scored by their likelihood a character, the end included. Those at least as likely
as nearly all labelled values of that kind are spans of the kind `learned`, if they are no
shorter than the shortest labelled value of that likelihood (or than `LONG`) and have letters
and digits where all of these have. Base spans always stay.

Spans are in code points, the end exclusive; a base span is the whole match.

Defined cases: a null text counts as empty and has no spans. Without labelled values nothing
is learnt and only base spans are found. Values over `LONGEST` characters aren't learnt from,
but are scored. Repeated rows count each. An empty table gives an empty result. Only id and
text are read; `redact` passes other columns through untouched, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, frugal

#: The base patterns and the length that a match needs (of group 2, if there is one).
BASE = {
    "assign": (re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 20),
    "hex": (re.compile(r"[0-9a-f]+"), 24),
}
#: Runs of fewer than 24 digits needn't be looked at: a run of [0-9a-f] matches whole or not at all.
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = [*BASE, "learned"]
#: Runs of this length are candidates even if all labelled values are longer.
LONG = 16
LABELLED, LONGEST, CONFIDENCE = 800, 128, 0.05
#: Tasks that bring together what all others found.
MERGING = 16
#: Values whose likelihood a task remembers.
REMEMBERED = 100_000
#: A learnt span may be less likely than all but this share of the labelled values by this much a character.
MISSED, MARGIN = 0.02, 0.1


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind, value"""
    found = []
    for kind, (pattern, least) in BASE.items():
        for m in (_HEX if kind == "hex" else pattern).finditer(text):
            value = m[pattern.groups]
            if len(value) >= least:
                found.append((m.start(), m.end(), kind, value))
    return found


def candidates(text: str, spans: list[tuple[int, int, str, str]], least: int) -> list[tuple[int, int, str]]:
    """Runs of at least so many characters outside the spans."""
    out, taken, k = [], sorted((s, e) for s, e, *_ in spans), 0
    for m in re.finditer(rf"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{{{max(0, least - 2)},}}[A-Za-z0-9+/_=-]", text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if not any(s < m.end() and e > m.start() for s, e in taken[k : k + 8]):
            out.append((m.start(), m.end(), m[0]))
    return out


def _classes(value: str) -> tuple[bool, bool]:
    """Whether there are digits and letters."""
    return any(map(str.isdigit, value)), any(map(str.isalpha, value))


class Automaton:
    """A probabilistic automaton inferred by ALERGIA from strings."""

    def __init__(self, strings: list[str], alpha: float = CONFIDENCE):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends, self.visits = [0], [0]
        for s in strings:
            at = 0
            self.visits[0] += 1
            for c in s:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                at = self.next[at][c]
                self.visits[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.alphabet = len({c for s in strings for c in s}) + 1
        of = sorted(rated := [self.likelihood(s) for s in strings])
        self.least = (of[int(MISSED * len(of))] if of else 0.0) - MARGIN
        typical = [s for s, x in zip(strings, rated, strict=True) if x >= self.least]
        self.shortest = min([LONG, *map(len, typical)])
        self.digits, self.letters = (all(has) for has in zip(*map(_classes, typical), strict=True)) if typical else (True, True)

    def fits(self, s: str) -> bool:
        """Whether s is as long as the shortest value and has the characters that all have."""
        digits, letters = _classes(s)
        return len(s) >= self.shortest and digits >= self.digits and letters >= self.letters

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.visits[p], self.visits[q]
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for c in self.count[p].keys() | self.count[q].keys():
                if self._differ(self.count[p].get(c, 0), n, self.count[q].get(c, 0), m):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to state p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            self.visits[p] += self.visits[q]
            for c, n in self.count[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def _merge(self) -> None:
        red, blue = [0], deque((0, c) for c in sorted(self.next[0]))
        while blue:
            parent, c = blue.popleft()
            q = self.next[parent][c]
            if q in red:
                continue
            for p in red:
                if self._compatible(p, q):
                    self.next[parent][c] = p
                    self._fold(p, q)
                    # states that the fold hung below red ones are blue now
                    seen = set(blue)
                    blue.extend(x for r in red for x in ((r, d) for d in sorted(self.next[r])) if self.next[r][x[1]] not in red and x not in seen)
                    break
            else:
                red.append(q)
                blue.extend((q, d) for d in sorted(self.next[q]))
        new = {old: i for i, old in enumerate(red)}
        self.next = [{c: new[t] for c, t in self.next[old].items() if t in new} for old in red]
        self.count, self.ends, self.visits = ([x[old] for old in red] for x in (self.count, self.ends, self.visits))

    def likelihood(self, s: str) -> float:
        """Mean log probability a character, the end included; what was never seen counts as half a time."""
        at, total = 0, 0.0
        for i, c in enumerate(s):
            n = self.visits[at] + 0.5 * self.alphabet
            total += math.log((self.count[at].get(c, 0) + 0.5) / n)
            if c not in self.next[at]:
                # off the automaton: the rest is as unlikely as can be
                total += (len(s) - i) * math.log(0.5 / (self.visits[0] + 0.5 * self.alphabet))
                return total / (len(s) + 1)
            at = self.next[at][c]
        return (total + math.log((self.ends[at] + 0.5) / (self.visits[at] + 0.5 * self.alphabet))) / (len(s) + 1)


def excess(automata: dict[str, Automaton], value: str) -> float:
    """By how much a value is likelier than the least likely labelled ones, at best; below 0 it isn't a secret."""
    return max((a.likelihood(value) - a.least for a in automata.values() if a.fits(value)), default=-math.inf)


class Scorer:
    """Learnt spans of texts, with a bounded store of what was said of values."""

    def __init__(self, automata: dict[str, Automaton]):
        self.least = min((a.shortest for a in automata.values()), default=LONG)
        self._excess = functools.lru_cache(REMEMBERED)(lambda value: excess(automata, value))
        self._any = bool(automata)

    def __call__(self, text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, float]]:
        """start, end, kind, excess"""
        # long values hardly repeat
        rate = lambda v: self._excess(v) if len(v) <= LONGEST else self._excess.__wrapped__(v)
        return [(s, e, "learned", x) for s, e, v in candidates(text, base, self.least) if (x := rate(v)) >= 0] if self._any else []


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, *_ in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode()) >> 1


def _cut(values: dict[str, int]) -> dict[str, int]:
    """Those of the least hashes."""
    return dict(sorted(values.items(), key=lambda x: (x[1], x[0]))[:LABELLED])


def _least(found: Iterator[tuple[str, str]]) -> dict[str, dict[str, int]]:
    """Of kinds and values the distinct values of the least hashes of each kind, with their hashes."""
    least: dict[str, dict[str, int]] = {k: {} for k in BASE}
    for kind, value in found:
        least[kind][value] = _hash(value)
        if len(least[kind]) > 4 * LABELLED:
            least[kind] = _cut(least[kind])
    return {kind: _cut(values) for kind, values in least.items()}


def labelled(docs: DataFrame, text_col: str = "text") -> dict[str, list[str]]:
    """Of each kind the LABELLED distinct values of the least hashes among all of at most LONGEST characters.

    A task hands over no more than that of each kind, and so does each of `MERGING` tasks that
    bring these together. Nothing is written: values are in the clear.
    """

    def rows(least: dict[str, dict[str, int]]) -> pa.RecordBatch:
        pairs = [(kind, value) for kind, values in least.items() for value in values]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.string()) for i in (0, 1)], ["kind", "value"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (text or "" for batch in batches for text in batch.column(0).to_pylist())
        yield rows(_least((kind, value) for text in texts for _, _, kind, value in base_spans(text) if len(value) <= LONGEST))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield rows(_least(pair for batch in batches for pair in zip(*(c.to_pylist() for c in batch.columns), strict=True)))

    schema = "kind string, value string"
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(frugal(find), schema)
    merged = found.repartition(MERGING).mapInArrow(frugal(merge), schema).collect()
    return {kind: sorted(values) for kind, values in _least((r["kind"], r["value"]) for r in merged).items() if values}


def infer(docs: DataFrame, text_col: str = "text") -> dict[str, Automaton]:
    """An automaton for each kind that has labelled values."""
    return {kind: Automaton(values) for kind, values in labelled(docs, text_col).items()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_learned, score.

    score: of the row's best learnt span, by how much a character it is likelier than the least likely labelled values.
    """
    sent = docs.sparkSession.sparkContext.broadcast(infer(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            counts, digests, spans, learned, scores = {k: [] for k in BASE}, [], [], [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text or "")
                for k in BASE:
                    counts[k].append(sum(s[2] == k for s in found))
                digests.append(hashlib.sha256(_joined(found).encode()).hexdigest())
                rated = scorer(text or "", found)
                spans.append(_joined(found + rated))
                learned.append(len(rated))
                scores.append(max((r[3] for r in rated), default=None))
            columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(learned, pa.int64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long, score double")


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """text with each span, or chain of overlapping spans, replaced."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with all secrets masked in the text; length_col, if there, follows the text where that changed."""
    sent = docs.sparkSession.sparkContext.broadcast(infer(docs, text_col))

    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                if text:
                    base = base_spans(text)
                    spans = [s[:2] for s in base + scorer(text, base)]
                    text = masked(text, spans) if spans else text
                out.append(text)
            yield pa.array(out, pa.string())

    @F.arrow_udf("string")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(texts)

    cleaned = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col in docs.columns:
        changed = F.contains(F.col(text_col), F.lit("[SECRET]"))
        cleaned = cleaned.withColumn(length_col, F.when(changed, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
