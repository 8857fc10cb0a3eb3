"""Secret scans by grammar inference.

Base patterns find credentials that are named or have a known prefix. Their values are labelled examples from which
probabilistic automata are inferred, one a label: a prefix tree over character classes whose statistically compatible
states are merged. A further automaton is learned from ordinary tokens: the candidates that no credential automaton
explains well, and whatever follows an @ or ://. So bare credentials do not become ordinary, however many they are; a token
that merely looks like a labelled value is taken for one. Every candidate token is then scored by the likelihood of its
format; one that a credential automaton explains clearly better than the ordinary one is added. How unlikely a value
may be follows from how the halves of a label's examples explain each other. Base spans always stay.

Candidates are runs of key characters with and without the dots at their end, what follows the first and the last '=' in a run, and the pieces between '=' and
'/'. They have a letter and a digit and ``USUAL`` characters, or as few as the shortest example of the label; without
a digit, both cases and a shape that words do not have. Letters of one case alone and digits alone are no candidates.

Learning reads the texts once and takes at most ``sample`` different values a label, those with the smallest hashes, of
at most ``longest`` characters; scanning covers every whole text, and every candidate is scored at its whole length.

Edge cases: a null or empty text has no spans; a null doc_id, repeated rows and further columns are carried along; in
an empty table nothing is learned and nothing found. Without credentials to learn from only base spans are returned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, least_hashes, map_arrow

#: The base patterns, and how long a match must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
ADDED = "inferred"
#: Kinds of candidates while learning: what follows an @ or ://, and others.
HOST, TOKEN = "host", "token"

SAMPLE = 1000
LONGEST = 256
#: Where candidates are looked for: runs of key characters with a letter and a digit, or with small before capital.
RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?:(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])|(?=[A-Za-z+/_.=-]*[a-z][A-Z]))[A-Za-z0-9+/_.=-]{6,}")
PIECE = re.compile(r"[^=/]+")
LETTER, DIGIT, STEP = re.compile("[A-Za-z]"), re.compile("[0-9]"), re.compile("[a-z][A-Z]")
#: Words in a row, as in CamelCase.
WORDS = re.compile(r"[+/_.=-]*+(?:[A-Z]?[a-z]++[+/_.=-]*+)++")
#: A candidate of so many characters need not be as long as the examples.
USUAL = 16
#: Confidence of a merge; nats by which the format must beat ordinary tokens; deviations that a value may be less likely than examples.
ALPHA, MARGIN, BELOW = 0.05, 6.0, 4.0
UNSEEN = -6.0

#: Character classes: digits, letters that are hexadecimal or not by case; other characters stand for themselves.
CLASSES = str.maketrans({c: k for k, chars in {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}.items() for c in chars})
ALPHABET = 5 + len("+/_.=-")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, number of the kind, value) in code points, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out)


@dataclass
class Automaton:
    """A deterministic probabilistic automaton over character classes; state 0 is the first."""

    total: list[int] = field(default_factory=lambda: [0])
    final: list[int] = field(default_factory=lambda: [0])
    edges: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])  # symbol -> [state, count]
    #: Of unseen examples, the mean nats a character and their deviation for one character; the shortest example.
    mean: float = -math.inf
    spread: float = 0.0
    shortest: int = USUAL

    def add(self, word: str) -> None:
        at = 0
        self.total[0] += 1
        for c in word:
            edge = self.edges[at].get(c)
            if edge is None:
                edge = self.edges[at][c] = [len(self.total), 0]
                self.total.append(0)
                self.final.append(0)
                self.edges.append({})
            edge[1] += 1
            at = edge[0]
            self.total[at] += 1
        self.final[at] += 1

    def log_likelihood(self, word: str) -> float:
        at, out = 0, 0.0
        for k, c in enumerate(word):
            edge = self.edges[at].get(c)
            if edge is None:
                return out + UNSEEN * (len(word) - k)
            out += math.log((edge[1] + 0.1) / (self.total[at] + 0.1 * (ALPHABET + 1)))
            at = edge[0]
        return out + math.log((self.final[at] + 0.1) / (self.total[at] + 0.1 * (ALPHABET + 1)))


def _differ(a: int, n: int, b: int, m: int, alpha: float) -> bool:
    return abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def _compatible(x: Automaton, a: int, b: int, alpha: float) -> bool:
    """Whether states a and b end and go on alike, and so do the states behind them."""
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        n, m = x.total[p], x.total[q]
        if not n or not m:
            continue
        if _differ(x.final[p], n, x.final[q], m, alpha):
            return False
        for c in x.edges[p].keys() | x.edges[q].keys():
            e, f = x.edges[p].get(c, (None, 0)), x.edges[q].get(c, (None, 0))
            if _differ(e[1], n, f[1], m, alpha):
                return False
            if e[0] is not None and f[0] is not None:
                todo.append((e[0], f[0]))
    return True


def _fold(x: Automaton, into: int, tree: int) -> None:
    todo = [(into, tree)]
    while todo:
        p, q = todo.pop()
        x.total[p] += x.total[q]
        x.final[p] += x.final[q]
        for c, (state, count) in x.edges[q].items():
            own = x.edges[p].get(c)
            if own is None:
                x.edges[p][c] = [state, count]
            else:
                own[1] += count
                todo.append((own[0], state))


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """The prefix tree of words with compatible states merged, most frequent first."""
    x = Automaton()
    for w in sorted(words):
        x.add(w)
    kept = [0]
    while True:
        known = set(kept)
        fringe = [(-x.total[e[0]], e[0], p, c) for p in kept for c, e in x.edges[p].items() if e[0] not in known]
        if not fringe:
            return x
        _, blue, parent, symbol = min(fringe)
        red = next((r for r in kept if _compatible(x, r, blue, alpha)), None)
        if red is None:
            kept.append(blue)
        else:
            x.edges[parent][symbol][0] = red
            _fold(x, red, blue)


def labelled_automaton(words: list[str]) -> Automaton:
    """The automaton of a label's examples, with what likelihoods to expect of further values."""
    x = infer(words)
    x.shortest = min(map(len, words))
    words = sorted(words)
    if len(words) > 1:
        scores = [(half.log_likelihood(w), len(w) + 1) for k in (0, 1) for half in [infer(words[1 - k :: 2])] for w in words[k::2]]
        x.mean = sum(s for s, _ in scores) / sum(n for _, n in scores)
        x.spread = math.sqrt(sum((s - x.mean * n) ** 2 / n for s, n in scores) / len(scores))
    return x


def candidates(text: str, spans: list[tuple[int, int, int, str]], shortest: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the candidates outside spans with shortest characters at least, longer ones of a run first."""
    for m in RUN.finditer(text):
        start, end = m.span()
        ends = dict.fromkeys((start + len(m[0].rstrip(".")), end))
        found = {(start, e): None for e in ends}
        if "=" in m[0] or "/" in m[0]:
            first, last = m[0].find("="), m[0].rstrip("=").rfind("=")
            found |= {(start + k + 1, e): None for k in (first, last) if k >= 0 for e in ends}
            found |= {(start + p.start(), start + p.end()): None for p in PIECE.finditer(m[0].rstrip("."))}
        for a, b in found:
            if b - a >= shortest and not _covered((a, b), spans):
                digit = DIGIT.search(text, a, b)
                if digit and LETTER.search(text, a, b) or not digit and b - a >= USUAL and STEP.search(text, a, b) and not WORDS.fullmatch(text, a, b):
                    yield a, b


def _shortest(automata: dict[str, Automaton]) -> int:
    return min([USUAL, *(a.shortest for kind, a in automata.items() if kind)])


def learn(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> dict[str, Automaton]:
    """An automaton for each kind that has examples, and one of ordinary tokens under ''. The texts are read once."""
    scratch = Scratch(docs.sparkSession)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[str, str]] = set()
            for text in batch.column(0).to_pylist():
                if text:
                    spans = base_spans(text)
                    rows.update((KINDS[k], v) for _, _, k, v in spans if len(v) <= longest)
                    for a, b in candidates(text, spans, 0):
                        if b - a <= longest:
                            host = text[a - 1 : a] == "@" or text[max(a - 3, 0) : a] == "://"
                            rows.add((HOST if host else TOKEN, text[a:b]))
            found = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.string()) for k in (0, 1)], ["kind", "value"])

    table = scratch.keep(map_arrow(docs.select("text"), values, "kind string, value string").distinct())
    counts = {r["kind"]: r["n"] for r in table.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    automata = {}
    for kind in KINDS:
        if kind in counts:
            own = least_hashes(table.where(F.col("kind") == kind), sample, counts[kind], "value").collect()
            automata[kind] = labelled_automaton([r["value"].translate(CLASSES) for r in own])
    shortest = _shortest(automata)

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            kept = [v for k, v in rows if len(v) >= shortest and (k == HOST or not _like_credential(v.translate(CLASSES), automata))]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], ["value"])

    plain = scratch.keep(map_arrow(table.where(F.col("kind").isin(HOST, TOKEN)), ordinary, "value string").distinct())
    words = [r["value"].translate(CLASSES) for r in least_hashes(plain, sample, plain.count(), "value").collect()]
    scratch.drop(table, plain)
    return automata | ({"": infer(words)} if words else {})


def _uniform(word: str) -> float:
    return -(len(word) + 1) * math.log(ALPHABET + 1)


def _best(word: str, automata: dict[str, Automaton]) -> float:
    """The likelihood of word by the credential automaton that explains it best, if any does well enough."""
    n, best = len(word) + 1, -math.inf
    for kind, a in automata.items():
        if kind and len(word) >= min(USUAL, a.shortest):
            found = a.log_likelihood(word)
            if found >= a.mean * n - BELOW * a.spread * math.sqrt(n):
                best = max(best, found)
    return best


def _like_credential(word: str, automata: dict[str, Automaton]) -> bool:
    return _best(word, automata) - _uniform(word) >= MARGIN


def _covered(span: tuple[int, int], spans: list[tuple[int, int, int, str]]) -> bool:
    return any(a < span[1] and span[0] < b for a, b, *_ in spans)


def added_spans(text: str, spans: list[tuple[int, int, int, str]], automata: dict[str, Automaton]) -> list[tuple[int, int]]:
    """Candidates outside spans whose format a credential automaton explains clearly better than ordinary tokens."""
    if not any(automata):
        return []
    out, held = [], (0, 0)
    for a, b in candidates(text, spans, _shortest(automata)):
        if not (a < held[1] and held[0] < b):
            word = text[a:b].translate(CLASSES)
            plain = max(automata[""].log_likelihood(word) if "" in automata else -math.inf, _uniform(word))
            if _best(word, automata) - plain >= MARGIN:
                out.append((a, b))
                held = max(held, (a, b), key=lambda s: s[1])
    return out


def scan(docs: DataFrame, automata: dict[str, Automaton] | None = None, with_text: bool = False) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>> by start[, masked text]) of every document."""
    automata = learn(docs) if automata is None else automata
    out = T.StructType([docs.schema["doc_id"]]).add("spans", T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")))
    out = out.add("masked", "string") if with_text else out
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, masked = [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text) if text else []
                found = [(a, k, b) for a, b, k, _ in spans]
                found += [(a, len(KINDS), b) for a, b in added_spans(text, spans, automata)] if text else []
                found.sort()
                every.append([{"kind": (*KINDS, ADDED)[k], "start": a, "end": b} for a, k, b in found])
                if with_text:
                    masked.append(mask(text, [(a, b) for a, _, b in found]))
            columns = [batch.column(0), pa.array(every, span)] + ([pa.array(masked, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays(columns, out.names)

    return map_arrow(docs.select("doc_id", "text"), run, out)


MASK = "[removed]"


def mask(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """text with each maximal run of covered characters replaced by one mark."""
    if not spans:
        return text
    parts, at = [], 0
    for a, b in sorted(spans):
        if a > at or not parts:
            parts += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def mask_documents(docs: DataFrame, automata: dict[str, Automaton] | None = None) -> DataFrame:
    """docs with every found span of text replaced by MASK; other columns as they are."""
    automata = learn(docs) if automata is None else automata
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                spans = base_spans(text) if text else []
                out.append(mask(text, [(a, b) for a, b, *_ in spans] + added_spans(text, spans, automata)) if text else text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_arrow(docs, run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``scan``."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["kind"] != ADDED)
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
