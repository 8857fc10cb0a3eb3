"""Line dedup: fuzzy lines by MinHash over character shingles.

Lines are known by a 64-bit hash, so copies of a line meet without moving its text. Each different line gets a
one-permutation MinHash of its character shingles, cut into bands; lines that share a band are compared exactly
(Jaccard of shingle sets, at least NUM/DEN), and links become components by distributed union-find (``links``). Of each
component the line that comes first by (doc_id, number) is kept, all others are removed from their documents.

Short lines have too few shingles for all bins, so each shingle is drawn several times for them: ``KINDS`` says how
often at which numbers of different shingles. Its ranges overlap, and a line gets the signatures of each that it lies
in, so lines of similarity NUM/DEN have a kind in common. With 29 bands of 6 a pair at the least similarity is missed
about once in 6,500, one of 0.85 once in 1,000,000.

Edge cases: blank lines are never removed and never a reason to remove; a null text has no lines and stays null. Lines
of fewer than ``SHINGLE`` characters are one shingle. Rows of one doc_id and one text count as one document, so copies
of a row keep the same lines. Rows with a null doc_id come first in the order. Very long lines are one line like others.
Input columns named n_lines or n_removed are replaced. Two different lines have one hash with a chance of about n^2 / 2^65
for n lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, U64, Scratch, map_arrow, mix, partitions, unused
from .links import PACKED, SKETCHES, Dealer, key_of, similarity_components, size_class, sketch
from .quality_rules import SPACE_CHARS

#: Characters of a shingle, which ``grams_of`` puts together from two pairs and one more.
SHINGLE = 5
NUM, DEN = 80, 100
BINS, BAND = 174, 6
#: (draws, least, most): how often a shingle is drawn for lines of so many different shingles.
KINDS = ((8, 0, 250), (2, 200, np.inf))
#: Characters whose shingles are made at once: their arrays stay in a core's cache.
CHUNK = 1 << 16
#: Hashes of lines that a task remembers, so that it signs copies once.
SEEN = 1_000_000

_PLACE = mix(np.arange(100, 103, dtype=np.uint64)) | U64(1)
_SALTS = mix(np.arange(1, 9, dtype=np.uint64) * GOLDEN) | U64(1)
_BANDS = mix(np.arange(500, 500 + BAND, dtype=np.uint64)) | U64(1)


def line_hash(line: str) -> int:
    """Spark's xxhash64 of the line, signed."""
    import xxhash

    h = xxhash.xxh64_intdigest(line.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def grams_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all lines one after the other, number of shingles of each line), repeated ones included."""
    sizes = np.array([len(x) for x in lines], np.int64)
    padded = np.frombuffer("".join(x + "\0" * SHINGLE for x in lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    pairs = padded[:-1] * _PLACE[0] + padded[1:]
    fours = pairs[:-2] * _PLACE[1] + pairs[2:]
    grams = fours[:-1] * _PLACE[2] + padded[4:]
    starts = np.cumsum(sizes + SHINGLE) - (sizes + SHINGLE)
    counts = np.maximum(sizes - SHINGLE + 1, 1)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return mix(grams[at]), counts


def once(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """grams_of without what repeats within a line."""
    line = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    own = np.sort((line << U64(48)) | (grams >> U64(16)))
    own = own[np.concatenate([[True], own[1:] != own[:-1]])]
    return own << U64(16), np.bincount((own >> U64(48)).astype(np.int64), minlength=len(counts))


def minhash(grams: np.ndarray, counts: np.ndarray, draws: int) -> np.ndarray:
    """(line, bin): the least hash that falls into each bin; an empty bin takes the next full one's."""
    out = np.full(len(counts) * BINS, ~U64(0), np.uint64)
    line = np.repeat(np.arange(len(counts)) * BINS, counts)
    for salt in _SALTS[:draws]:
        h = grams * salt
        np.minimum.at(out, line + ((h >> U64(40)) * U64(BINS) >> U64(24)).astype(np.int64), h)
    out = out.reshape(-1, BINS)
    empty = out == ~U64(0)
    if empty.any():
        place = np.where(np.concatenate([empty, empty], axis=1), 2 * BINS, np.arange(2 * BINS))
        ahead = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :BINS]
        out = np.take_along_axis(out, ahead % BINS, axis=1) + (ahead - np.arange(BINS)).astype(np.uint64) * GOLDEN
    return out


def signed(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, number of the line of each, number of different shingles of each line)."""
    parts = []
    for k in range(0, len(lines), 1 << 14):  # a line's number has 16 bits in once()
        grams, counts = once(*grams_of(lines[k : k + (1 << 14)]))
        ends, sigs, owners = np.cumsum(counts), [], []
        for draws, least, most in KINDS:
            own = np.flatnonzero((counts >= least) & (counts <= most))
            if len(own):
                some = grams[np.repeat(ends[own] - np.cumsum(counts[own]), counts[own]) + np.arange(counts[own].sum())]
                h = minhash(some, counts[own], draws).reshape(len(own), BINS // BAND, BAND)
                with np.errstate(over="ignore"):
                    band = (h * _BANDS).sum(axis=2) + np.arange(BINS // BAND, dtype=np.uint64) * GOLDEN + U64(draws)
                sigs.append(mix(band).ravel())
                owners.append(np.repeat(own + k, BINS // BAND))
        parts.append((np.concatenate(sigs), np.concatenate(owners), counts))
    return tuple(np.concatenate(x) for x in zip(*parts))


def band_signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, number of the line of each). Which kinds a line gets depends on its different shingles."""
    return signed(lines)[:2]


def line_sets(lines: list[bytes]) -> list[np.ndarray]:
    """The set of each line; shingles are made for many lines at once."""
    out, at = [], 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and size < CHUNK:
            size += len(lines[end])
            end += 1
        grams, counts = grams_of([x.decode() for x in lines[at:end]])
        for stop, n in zip(np.cumsum(counts), counts):
            own = np.sort(grams[stop - n : stop])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        at = end
    return out


def shingles(line: bytes) -> np.ndarray:
    """The set of a line."""
    return line_sets([line])[0]


def lines_of(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x.strip(SPACE_CHARS)]


def _packed(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, seen = Dealer(buckets), set()
        held: dict[int, str] = {}
        size = 0

        def deal() -> None:
            if held:
                hashes = np.fromiter(held, np.int64, len(held))
                sigs, owner, counts = signed(list(held.values()))
                dealer.add(sigs, hashes[owner], size_class(counts)[owner])
                held.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line in lines_of(text):
                    h = line_hash(line)
                    if h not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(h)
                        held[h] = line
                        size += len(line)
                        if size >= CHUNK:
                            deal()
                            size = 0
                            if dealer.full():
                                yield dealer.rows()
        deal()
        yield dealer.rows()

    return map_arrow(docs.select("text"), run, PACKED)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, payload) of wanted lines (id, doc, row, no): one row a line says where it stands. Copies of a row give it again."""
    places = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("id", "no")).alias("lines")).hint("shuffle_hash")
    both = docs.join(places, (docs.doc_id.eqNullSafe(places.doc)) & (docs.row == places.row)).select("text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, items = [], []
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = text.split("\n")
                for place in places:
                    ids.append(place["id"])
                    items.append(lines[place["no"]].encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.binary())], ["id", "payload"])

    return map_arrow(both, run, "id long, payload binary")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = line_sets(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x).tobytes() for x in sets], pa.binary())], ["key", "size", "sketch"])


def dedupe(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs with text less its removed lines, n_lines and n_removed (lines that are not blank)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    row, gone, split = unused(columns, "row", "gone", "parts")
    docs = docs.select(*columns, F.xxhash64("text").alias(row))
    buckets = 4 * partitions(spark)
    texts = docs.select("doc_id", F.col(row).alias("row"), "text").where("text is not null")
    every = texts.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.btrim("line", F.lit(SPACE_CHARS)) != "")
    lines = scratch.keep(every.select(F.xxhash64("line").alias("id"), F.struct(F.col("doc_id").alias("doc"), "row", "no").alias("at")))
    exact = scratch.keep(lines.groupBy("id").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    scratch.sweep()
    fetched: list[DataFrame] = []

    def sketches_of(keys: DataFrame) -> DataFrame:
        wanted = exact.select("id", "first.*", key_of("id").alias("key")).join(keys, "key", "left_semi")
        fetched.append(scratch.keep(_texts(texts, wanted)))
        return map_arrow(fetched[0].select(key_of("id").alias("key"), "payload"), _sketched, SKETCHES)

    def payload_of(wanted: DataFrame) -> DataFrame:
        return fetched[0].select("id", "payload", key_of("id").alias("key")).join(wanted, "key").select("g", "id", "payload")

    labels = similarity_components(_packed(texts, buckets), buckets, sketches_of, payload_of, line_sets, num, den, scratch)
    labels = scratch.keep(labels, True)
    similar = scratch.keep(exact.join(labels, "id").select("id", "first", "component"), True)
    keepers = similar.groupBy("component").agg(F.min("first").alias("keeper"))
    alone = exact.where("n > 1").join(labels, "id", "left_anti").select("id", F.col("first").alias("keeper"))
    repeated = scratch.keep(similar.join(keepers, "component").select("id", "keeper").union(alone), True)
    removed = lines.join(repeated, "id").where("at <> keeper").select("at.*").groupBy("doc", "row").agg(F.collect_set("no").alias("no"))
    doc, at = unused([*docs.columns, gone], "doc", "at")
    removed = scratch.keep(removed, True).select(F.col("doc").alias(doc), F.col("row").alias(at), F.col("no").alias(gone)).hint("shuffle_hash")
    scratch.drop(*fetched)
    found = docs.join(removed, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(row) == F.col(at)), "left")
    parts = F.when(F.col("text").isNotNull(), F.split("text", "\n")).alias(split)
    found = found.select(*(F.col(c) for c in columns), gone, parts)
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    size = F.coalesce(F.size(F.filter(split, lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")), F.lit(0))
    return found.select(*(kept.alias(c) if c == "text" else F.col(c) for c in columns), F.greatest(size, F.lit(0)).cast("long").alias("n_lines"), F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256)."""
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def oracle() -> str:
    """The digest of ``op4_line_dedup`` in DuckDB's SQL, with all pairs of lines that share a shingle; a doc_id has one row."""
    blank = r"[^\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, no, parts[no] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS no FROM d) WHERE regexp_matches(parts[no], '{blank}')),
u AS (SELECT line, row_number() OVER (ORDER BY min((doc_id, no))) AS id FROM l GROUP BY line),
g AS (SELECT DISTINCT id, substr(line, i, {SHINGLE}) AS g FROM (SELECT id, line, unnest(range(1, greatest(length(line) - {SHINGLE - 2}, 2))) AS i FROM u)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
s AS (SELECT g.id, g.g, n.n FROM g JOIN n ON g.id = n.id),
k AS (SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.g = y.g AND x.id < y.id AND {DEN} * least(x.n, y.n) >= {NUM} * greatest(x.n, y.n)
      GROUP BY x.id, y.id, x.n, y.n HAVING {DEN} * count(*) >= {NUM} * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT a AS id, a AS c FROM (SELECT DISTINCT a FROM e) UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a AND r.c < e.b),
c AS (SELECT u.line, coalesce(min(r.c), u.id) AS c FROM u LEFT JOIN r ON u.id = r.id GROUP BY u.line, u.id),
f AS (SELECT doc_id, no, row_number() OVER (PARTITION BY c ORDER BY doc_id NULLS FIRST, no) > 1 AS gone FROM l JOIN c ON l.line = c.line),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, list(no) FILTER (gone) AS nos FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(CASE WHEN coalesce(n_removed, 0) = 0 THEN text ELSE array_to_string([parts[i] FOR i IN range(1, len(parts) + 1) IF NOT list_contains(nos, i)], chr(10)) END, '')) AS kept_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id"""
