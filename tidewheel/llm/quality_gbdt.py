"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass over the texts gives a small table of statistics. A bounded sample of labelled rows, ``sample`` at most and
those whose doc_ids have the smallest hashes, trains the trees on the driver; the trees are flattened into arrays, and every document
is scored by walking all trees at once with numpy.

Edge cases: a null or empty text has statistics of zero and a score; labels of null or of documents that are not there
are ignored; without labels, or with one class only, every score is that class's share (0.5 without any). A null doc_id
is scored and never held out; repeated rows are scored each; further columns are ignored, so that neither labels, lang,
source nor doc_id reach a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, least_hashes, map_arrow, utf8
from .quality_rules import STOP_WORDS

SAMPLE = 20_000
STATISTICS = ("bytes", "words", "word_length", "distinct_words", "repeated_words", "stop_words", "long_words", "lines", "distinct_lines", "line_words", "upper", "digits", "symbols", "marks", "bars", "bangs", "stops", "spaces", "beyond_ascii")
_STOP = frozenset(w.encode() for words in STOP_WORDS.values() for w in words)


def _bytes_of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_GROUPS = [_bytes_of(x) for x in (bytes(range(65, 91)), b"0123456789", b"#*$%&<>@^~_=+\\{}[]", b",;:'\"()-/?", b"|", b"!", b".", b" \t\n\r\x0b\x0c", bytes(range(128, 256)))]


def statistics_of(text: bytes) -> list[float]:
    """The STATISTICS of one text; shares are of its bytes, words or lines."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, w, k = max(len(text), 1), max(len(words), 1), max(len(lines), 1)
    tally = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    distinct = set(words)
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(map(len, words)) / w, len(distinct) / w, sum(map(eq, words, words[1:])) / w,
        sum(map(_STOP.__contains__, words)) / w, sum(len(x) > 20 for x in distinct) / max(len(distinct), 1), float(np.log1p(len(lines))), len(set(lines)) / k, w / k,
        *(float(tally[g].sum()) / n for g in _GROUPS),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics_of(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, x array<double>")


@dataclass
class Trees:
    """All trees as arrays of (tree, node): a node sends x[feature] <= cut to 2i + 1, else to 2i + 2; leaves end at depth."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.cut[trees, at])
        return self.start + self.value[trees, at].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Trees for the logistic loss; each split is sought in histograms of gradients over quantile bins."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    inner = 2**depth - 1
    out = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2 * inner + 1)), float(np.log(share / (1 - share))), depth)
    if not len(y) or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(x.shape[1]) * bins
    margin = np.full(len(y), out.start)
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2 * inner + 1)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for i in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == i)
                if len(own):
                    size = x.shape[1] * bins
                    g = np.bincount(flat[own].ravel(), np.repeat(grad[own], x.shape[1]), size).reshape(-1, bins).cumsum(axis=1)
                    h = np.bincount(flat[own].ravel(), np.repeat(hess[own], x.shape[1]), size).reshape(-1, bins).cumsum(axis=1)
                    g_all, h_all = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                    gain[(h < least) | (h_all - h < least)] = 0
                    f, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[f, b] > 1e-9 and b < len(edges[f]):
                        feature[i], cut[i] = f, edges[f][b]
                        node[own] = 2 * i + 1 + (binned[own, f] > b)
                        continue
                    node[own] = 2 * i + 1  # all go left, as nothing exceeds an infinite cut
        g, h = np.bincount(node, grad, 2 * inner + 1), np.bincount(node, hess, 2 * inner + 1)
        value[inner:] = (-rate * g / (h + ridge))[inner:]
        margin += value[node]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    out.feature, out.cut, out.value = np.stack(features), np.stack(cuts), np.stack(values)
    return out


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; learned from labels of rows that are not held out."""
    scratch = Scratch(docs.sparkSession)
    table = scratch.keep(statistics(docs))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y")).where(~held_out())
    chosen = least_hashes(known, sample, known.count(), "doc_id")
    rows = table.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x", "y").limit(sample).select("x", "y").collect()
    model = fit(np.array([r["x"] for r in rows]).reshape(-1, len(STATISTICS)), np.array([r["y"] for r in rows]))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = map_arrow(table, run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
