"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct word shingles. Sets fall into bands of sizes, so that sets of similarity 0.8 lie in one
band or in neighbours; for each pair of neighbouring bands the similarity bounds the number of differing elements, k.
The domain of shingles is cut into parts by a hash, so few that similar sets differ by at most ``left_out`` elements in
one part at least; a part is cut into subparts, and each subset of them that leaves out so many makes a signature: the
hash of the set's elements there. Similar sets agree on one of them. Large k would take many subsets, so beyond
``SUBSETS_UPTO`` elements a part has one subpart and nothing is left out. A part is safe if no signature of it is that
of the empty set; a set with too few safe parts repeats this with a further hash, and two similar sets share a signature
of the first hash at which either stops. So no link is missed, whatever the texts.

Sets that share signatures are compared exactly, and links become components (``links``). Equal sets are one item.

Edge cases: null and empty texts have the empty set and are linked with nothing; under ``words`` words the whole
sequence is the one shingle. Rows of one doc_id are one node; a null doc_id is linked with nothing and has a null
component. Further columns are ignored. Two different sets have one hash with a chance of about n^2 / 2^65 for n sets.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, U64, Scratch, components, map_arrow, mix, partitions, utf8
from .links import PACKED, Dealer, key_of, similarity_components, size_class, sketch

WORDS = 5
#: The least similarity as a fraction.
NUM, DEN = 80, 100
CHUNK = 1 << 20
#: Where similar sets differ by at most SUBSETS_UPTO elements, a part has subparts, of which a signature leaves out LEFT_OUT.
SUBSETS_UPTO, LEFT_OUT = 36, 3
#: Hashes of sets that a task remembers, so that it signs copies once.
SEEN = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_CODE[65:91] = _CODE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 5
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PLACE = mix(np.arange(900, 900 + 64, dtype=np.uint64)) | U64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 2 * len(_POWERS[0]), 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base & (2**64 - 1), np.uint64)]))
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of the texts, number of words up to each text's end); A-Z count as a-z."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    powers, inverse = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[data] * powers[: len(data)])])
    blank = np.concatenate([[True], _SPACE[data], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    words = mix((total[ends] - total[starts]) * inverse[starts])
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.searchsorted(starts, text_ends)


def shingle_sets(texts: list[bytes], n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
            size += len(texts[end]) + 1
            end += 1
        words, upto = word_hashes(texts[at:end])
        grams = np.zeros(max(len(words) - n + 1, 0), np.uint64)
        for k in range(n):
            grams += words[k : k + len(grams)] * _PLACE[k]
        grams = mix(grams)
        first = 0
        for last in upto:
            if last - first >= n:
                yield np.unique(grams[first : last - n + 1])
            elif last > first:
                yield mix((words[first:last] * _PLACE[: last - first]).sum(keepdims=True) + _PLACE[32 + last - first])
            else:
                yield np.empty(0, np.uint64)
            first = last
        at = end


@dataclass(frozen=True)
class Shape:
    """How a pair of neighbouring bands cuts the domain: parts, subparts of a part, and subparts that a signature leaves out."""

    parts: int
    subparts: int
    left_out: int
    #: Parts of a set that must be safe for it to stop.
    safe: int
    #: (subset, subpart): the subsets of a part's subparts, one a signature.
    subsets: np.ndarray


class Bands:
    """Size bands and the cut of the domain for the pair (band - 1, band), for a similarity of at least num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low, self.high = num, den, [0], [0]

    def of(self, size: int) -> int:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(self.low[-1] * self.den // self.num)
        return bisect_left(self.high, size)

    def differing(self, band: int) -> int:
        """The most elements by which similar sets in bands band - 1 and band differ."""
        while len(self.high) <= band:
            self.of(self.high[-1] + 1)
        # |x or y| - |x and y| <= (den - num) / (den + num) * (|x| + |y|), and neither set exceeds the band.
        return 2 * self.high[band] * (self.den - self.num) // (self.den + self.num)

    def shape(self, band: int) -> Shape:
        k = self.differing(band)
        if k <= SUBSETS_UPTO:
            left_out = min(k, LEFT_OUT)
            need = -(-(k + 1) // (left_out + 1))
            parts = need
            size = left_out + 2 if left_out else 1
        else:
            left_out, size, need = 0, 1, k + 1
            parts = need
            for _ in range(6):
                empty = parts * math.exp(-max(self.low[band - 1], 1) / parts)  # expected in the smallest sets of the pair
                parts = need + math.ceil(empty + 2 * math.sqrt(empty))
        chosen = list(combinations(range(size), size - left_out))
        return Shape(parts, size, left_out, need, np.array([[c in x for c in range(size)] for x in chosen]))


def signatures(items: np.ndarray, bands: Bands, cache: dict[int, Shape]) -> np.ndarray:
    """The PartEnum signatures of a set in the two pairs of bands that it belongs to."""
    out = []
    own = bands.of(len(items))
    for band in (own, own + 1):
        if band not in cache:
            cache[band] = bands.shape(band)
        shape = cache[band]
        n = shape.parts * shape.subparts
        for turn in range(1 << 16):
            h = items if not turn else np.sort(mix(items ^ mix(np.full(1, turn, np.uint64) * GOLDEN)))
            part = (h >> U64(32)) * U64(n) >> U64(32)
            cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
            inside = np.add.reduceat(mix(h ^ GOLDEN), cut)
            seed = np.full(1, (band << 20 | turn) + 1, np.uint64) * _PLACE[63]
            if shape.subparts == 1:
                out.append(mix(inside + part[cut] * GOLDEN + seed))
                safe = len(cut)
            else:
                held = np.zeros(n, np.uint64)
                held[part[cut].astype(np.int64)] = mix(inside + part[cut] * GOLDEN)
                held = held.reshape(shape.parts, -1)
                found = held @ shape.subsets.T.astype(np.uint64)
                place = np.arange(found.size, dtype=np.uint64).reshape(found.shape)
                out.append(mix(found + place * GOLDEN + seed)[found != 0])
                safe = int(((held != 0).sum(axis=1) > shape.left_out).sum())
            if safe >= shape.safe:
                break
    return np.concatenate(out)


def set_hash(items: np.ndarray) -> int:
    """The 64-bit hash by which equal sets are known, signed."""
    with np.errstate(over="ignore"):
        h = mix(mix(items ^ GOLDEN).sum(keepdims=True) + U64(len(items)) * GOLDEN)
    return int(h.view(np.int64)[0])


def link_components(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id that links reach."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    buckets = 4 * partitions(spark)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, sketches = [], [], []
            for doc, items in zip(batch.column(0).to_pylist(), shingle_sets(utf8(batch.column(1)), words)):
                linked = doc is not None and len(items) > 0
                sizes.append(len(items))
                ids.append(set_hash(items) if linked else None)
                sketches.append(sketch(items).tobytes() if linked else None)
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_shingles", "id", "sketch"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, bands, cache, seen = Dealer(buckets), Bands(num, den), {}, set()
        for batch in batches:
            for items in shingle_sets(utf8(batch.column(0)), words):
                if len(items) and (own := set_hash(items)) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(own)
                    sigs = signatures(items, bands, cache)
                    dealer.add(sigs, np.full(len(sigs), own), np.full(len(sigs), size_class(np.array([len(items)]))[0]))
                    if dealer.full():
                        yield dealer.rows()
        yield dealer.rows()

    table = scratch.keep(map_arrow(docs, members, f"doc_id {kind}, row long, n_shingles long, id long, sketch binary"))
    linked = table.where("id is not null")
    firsts = linked.groupBy("id").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("copies"))

    def sketches_of(keys: DataFrame) -> DataFrame:
        own = linked.select(key_of("id").alias("key"), "id", F.col("n_shingles").alias("size"), "sketch").join(keys, "key", "left_semi")
        return own.groupBy("key", "id").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch")).drop("id")

    def payload_of(wanted: DataFrame) -> DataFrame:
        own = firsts.select("id", "first.*", key_of("id").alias("key")).join(wanted, "key").select("doc_id", "row", "id", "g")
        return docs.join(own.hint("shuffle_hash"), ["doc_id", "row"]).select("g", "id", F.coalesce("text", F.lit("")).cast("binary").alias("payload"))

    sets_of = lambda texts: list(shingle_sets(texts, words))
    labels = similarity_components(map_arrow(docs.where("doc_id is not null").select("text"), packed, PACKED), buckets, sketches_of, payload_of, sets_of, num, den, scratch)
    # Rows of one doc_id are one node, whatever their texts.
    several = linked.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("doc_id", "low")
    if not several.isEmpty():
        same = linked.join(several, "doc_id").select(F.col("id").alias("a"), F.col("low").alias("b"))
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(same), scratch).select(F.col("node").alias("id"), "component")
    classes = firsts.join(labels, "id", "left").select("id", F.col("first.doc_id").alias("low"), "copies", F.coalesce("component", "id").alias("c"))
    lows = classes.groupBy("c").agg(F.min("low").alias("component_id"), F.sum("copies").alias("n")).where("n > 1").select("c", "component_id")
    found = table.select("doc_id", "n_shingles", "id").join(scratch.keep(classes.join(lows, "c").select("id", "component_id")), "id", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id. Rows of a null doc_id stay."""
    rest = link_components(docs, words, num, den).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(rest, "doc_id", "left_anti").select(*docs.columns)


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + {WORDS - 1}), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE {DEN} * inter >= {NUM} * (x.n + y.n - inter)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON w.doc_id = c.a"""
