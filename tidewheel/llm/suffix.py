"""Suffix-array dedup by bucket-pointer refinement: remove every byte of a LENGTH-byte string that starts twice.

Refining every suffix of a corpus together would move them all, so runs of starts meet first. Each window of LENGTH
bytes names the least fingerprint of ANCHOR bytes in it; consecutive windows that name the same one are a run, and equal
strings lie in runs of the same name. Runs whose strings all equal another run's, by the fingerprint of all of them, are
settled as a whole.

Where runs share a name but not their strings, their texts meet in one task, and their suffixes are sorted by
bucket-pointer refinement: buckets of the first two bytes are refined by sorting on the bucket of the suffix two
further on, which gives buckets of four bytes, and so on to LENGTH, each refinement using the identifiers that the one
before has updated. A suffix that is alone in its bucket is not sorted again. Suffixes that still share a bucket at
LENGTH are equal, whatever fingerprints say.

A name with more than ``RUNS`` different runs would not fit one task: its single starts are dealt out by their
fingerprints and meet by these instead.

Fingerprints, by which runs get names and are settled as a whole, are 64-bit; those of different strings are equal with
a chance of about n^2 / 2^65 for n strings compared.

Edge cases: a null or empty text has no bytes; texts under LENGTH bytes lose nothing; a string that repeats within one
document counts; repeated rows are two places. A null doc_id is carried along. Texts of any length are read whole;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, U64, Scratch, map_arrow, mix, utf8

LENGTH, ANCHOR = 400, 128
#: Windows that lie in one string of LENGTH bytes.
SPAN = LENGTH - ANCHOR + 1
CHUNK = 1 << 17
#: Different runs of one name whose texts meet in one task.
RUNS = 20_000
#: Bytes of runs that are refined together.
TOGETHER = 1 << 20

_FACTOR = mix(np.arange(40, 48, dtype=np.uint64)) | U64(1)


def refined(data: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Fingerprints of the strings of 8, 16, ... upto bytes at each place of data; shorter arrays at greater depths."""
    n = len(data) - 7
    at = {8: mix(np.ndarray((n,), "<u8", data, strides=(1,)) * GOLDEN)} if n > 0 else {8: np.empty(0, np.uint64)}
    d, k = 8, 0
    while 2 * d <= upto:
        x = at[d]
        at[2 * d] = x[:-d] * _FACTOR[k] + x[d:] if len(x) > d else np.empty(0, np.uint64)
        d, k = 2 * d, k + 1
    return at


def at_length(ids: dict[int, np.ndarray], length: int = LENGTH) -> np.ndarray:
    """Fingerprints at depth length, out of the two overlapping pieces of the greatest power below it."""
    d = max(ids)
    x, back = ids[d], length - d
    return mix(x[:-back] * _FACTOR[7] + x[back:]) if len(x) > back else np.empty(0, np.uint64)


def window_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each window of size."""
    d = 1
    while 2 * d <= size:
        x = np.minimum(x[:-d], x[d:])
        d *= 2
    return np.minimum(x[: len(x) - (size - d)], x[size - d :]) if size > d else x


def grouped(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(first, last) of stretches of texts of about CHUNK bytes."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first start, number of starts, name, fingerprint of all strings, whether the name occurs twice) of every run."""
    found = []
    for a, b in grouped(texts):
        own = [k for k in range(a, b) if len(texts[k]) >= LENGTH]
        if not own:
            continue
        sizes = np.array([len(texts[k]) for k in own])
        data = np.frombuffer(b"".join(texts[k] for k in own), np.uint8)
        ends = np.cumsum(sizes)
        ids = refined(data, 256)
        whole = at_length(ids)
        anchors = mix(ids[ANCHOR] ^ GOLDEN)
        names = window_least(anchors, SPAN)[: len(whole)]
        text = np.repeat(np.arange(len(own)), sizes)[: len(whole)]
        ok = np.arange(len(whole)) + LENGTH <= ends[text]
        new = np.ones(len(whole), bool)
        new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
        starts = np.flatnonzero(new & ok)
        stop = np.flatnonzero(ok & np.concatenate([new[1:] | ~ok[1:], [True]])) + 1
        counts = stop - starts
        place = np.arange(len(whole)) - starts[np.maximum(np.searchsorted(starts, np.arange(len(whole)), "right") - 1, 0)]
        marked = np.where(ok, mix(whole + place.astype(np.uint64) * GOLDEN), U64(0))
        prints = mix(np.add.reduceat(marked, starts) + counts.astype(np.uint64))
        # A name that occurs at two places of the chunk may cover strings that repeat within one run.
        table = np.zeros(1 << 16, bool)
        table[(names[starts] & U64(0xFFFF)).astype(np.int64)] = True
        some = np.sort(anchors[table[(anchors & U64(0xFFFF)).astype(np.int64)]])
        twice = some[1:][some[1:] == some[:-1]]
        again = np.isin(names[starts], twice)
        first = starts - (ends - sizes)[text[starts]]
        found.append((np.array(own)[text[starts]], first, counts, names[starts], prints, again))
    if not found:
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool))
    return tuple(np.concatenate(x) for x in zip(*found))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(0).to_numpy()
        text, first, counts, names, prints, again = runs_of(utf8(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(rows[text]), pa.array(first), pa.array(counts), pa.array(names.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(again)], ["row", "first", "n", "name", "print", "again"])


def buckets_of(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, whether a bucket of first begins, whether one of both begins): places sorted by first, then second."""
    n, top = len(first), int(max(first.max(), second.max())).bit_length()
    low = n.bit_length()
    if 2 * top + low <= 63:  # one sort of whole words
        packed = np.sort((((first << top) | second) << low) | np.arange(n))
        order = packed & ((1 << low) - 1)
    else:
        order = np.lexsort((second, first))
    x, y = first[order], second[order]
    outer = np.concatenate([[True], x[1:] != x[:-1]])
    return order, outer, outer | np.concatenate([[True], y[1:] != y[:-1]])


def repeated_places(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each of the starts, whether its length bytes also begin at another of them.

    A bucket's identifier is the number of suffixes before it, so refining it leaves all others as they are.
    """
    if not len(starts):
        return np.empty(0, bool)
    pairs = (data[:-1].astype(np.int64) << 8) | data[1:]
    order = np.argsort(pairs.astype(np.uint16), kind="stable")
    own = pairs[order]
    begins = np.concatenate([[True], own[1:] != own[:-1]])
    bucket = np.empty(len(pairs), np.int64)
    bucket[order] = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    alone = begins & np.concatenate([begins[1:], [True]])
    active = np.sort(order[~alone])
    depth = 2
    while 2 * depth < length:
        active = active[active + depth < len(bucket)]
        if len(active):
            first = bucket[active]
            order, outer, inner = buckets_of(first, bucket[active + depth])
            place = np.arange(len(order))
            since = place[inner][np.cumsum(inner) - 1] - place[outer][np.cumsum(outer) - 1]
            places = active[order]
            bucket[places] = first[order] + since
            active = np.sort(places[~(inner & np.concatenate([inner[1:], [True]]))])
        depth *= 2
    order, _, inner = buckets_of(bucket[starts], bucket[starts + length - depth])
    out = np.empty(len(starts), bool)
    out[order] = ~(inner & np.concatenate([inner[1:], [True]]))
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, print, n, data): the bytes of some runs."""
    for batch in batches:
        rows = [(run["name"], run["print"], run["n"], text[run["first"] : run["first"] + run["n"] + LENGTH - 1]) for text, runs in zip(utf8(batch.column(0)), batch.column(1).to_pylist()) for run in runs]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, types)], ["name", "print", "n", "data"])


def _stretches(run: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first, number) of consecutive places at of the same run."""
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(run) != 0)])) if len(at) else np.empty(0, np.int64)
    return run[cut], at[cut], np.diff(np.append(cut, len(at)))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, print, start, n): stretches of starts whose strings occur twice among the runs of a name. Names come one after the other."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def refined_together(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        counts = np.array([r[2] for r in rows], np.int64)
        ends = np.cumsum([len(r[3]) for r in rows])
        run = np.repeat(np.arange(len(rows)), counts)
        at = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        begins = ends - np.array([len(r[3]) for r in rows], np.int64)
        # Equal strings have equal names, so runs of several names may be refined as one text.
        twice = repeated_places(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), begins[run] + at)
        run, first, n = _stretches(run[twice], at[twice])
        names, prints = (np.array([r[k] for r in rows], np.int64)[run] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (names, prints, first, n)], ["name", "print", "start", "n"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= TOGETHER and row[0] != held[-1][0]:
                yield refined_together(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield refined_together(held)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints at depth LENGTH of the starts of some runs: (name, salt, print, at, ids)."""
    for batch in batches:
        names, salts, prints, places, ids = [], [], [], [], []
        for text, runs in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
            data = np.frombuffer(text, np.uint8)
            for run in runs:
                own = at_length(refined(data[run["first"] : run["first"] + run["n"] + LENGTH - 1], 256))
                deal = own % U64(run["salts"])
                for salt in range(run["salts"]):
                    at = np.flatnonzero(deal == salt)
                    if len(at):
                        names.append(run["name"])
                        salts.append(salt)
                        prints.append(run["print"])
                        places.append(at.astype("<i4").tobytes())
                        ids.append(own[at].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(salts, pa.int32()), pa.array(prints, pa.int64()), pa.array(places, pa.binary()), pa.array(ids, pa.binary())], ["name", "salt", "print", "at", "ids"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, print, start, n): stretches of starts whose strings occur twice among the runs of a row."""
    for batch in batches:
        out = [[], [], [], []]
        for name, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.concatenate([np.frombuffer(r["ids"], np.uint64) for r in runs])
            at = np.concatenate([np.frombuffer(r["at"], "<i4") for r in runs]).astype(np.int64)
            run = np.repeat(np.arange(len(runs)), [len(r["at"]) // 4 for r in runs])
            order = np.argsort(ids, kind="stable")
            same = ids[order][1:] == ids[order][:-1]
            twice = np.zeros(len(ids), bool)
            twice[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            for k, first, n in zip(*_stretches(run[twice], at[twice])):
                for column, value in zip(out, (name, runs[k]["print"], int(first), int(n))):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["name", "print", "start", "n"])


def removed(size: int, spans: list[dict]) -> list[tuple[int, int]]:
    """The maximal [start, end) that strings starting in spans cover."""
    out: list[list[int]] = []
    for start, n in sorted((s["start"], s["n"]) for s in spans or ()):
        end = min(start + n - 1 + LENGTH, size)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def decoded(text: bytes) -> str | None:
    try:
        return text.decode()
    except UnicodeDecodeError:
        return None


def repeated_starts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, start, n): stretches of starts of repeated strings; row is the hash of doc_id and text."""
    runs = scratch.keep(map_arrow(docs.select("row", "text"), _runs, "row long, first long, n long, name long, print long, again boolean"))
    shared = runs.groupBy("name").agg(F.count("*").alias("c"), F.max("again").alias("again")).where("c > 1 or again").select("name")
    some = scratch.keep(runs.join(shared, "name", "left_semi"))
    kinds = scratch.keep(some.groupBy("name", "print").agg(F.count("*").alias("copies"), F.max("again").alias("again"), F.min(F.struct("row", "first", "n")).alias("one")))
    scratch.drop(runs)
    scratch.sweep()
    whole = some.join(kinds.where("copies > 1").select("name", "print"), ["name", "print"]).select("row", F.col("first").alias("start"), "n")
    # A name is open while one of its runs is alone with its strings: those may be part of another run's.
    groups = kinds.groupBy("name").agg(F.min("copies").alias("least"), F.count("*").alias("kinds"), F.max("again").alias("again")).where("least = 1 and (kinds > 1 or again)")
    todo = kinds.join(groups.select("name", F.ceil(F.col("kinds") / RUNS).cast("int").alias("salts")), "name").select("name", "print", "copies", "salts", "one.*")
    todo = scratch.keep(todo)
    schema = "name long, print long, start long, n long"

    def meeting(some: DataFrame) -> DataFrame:
        """(text, runs) of the documents that hold the runs."""
        asked = some.groupBy("row").agg(F.collect_list(F.struct("name", "print", "salts", "first", "n")).alias("runs"))
        return docs.select("row", "text").join(asked.hint("shuffle_hash"), "row").dropDuplicates(["row"]).select("text", "runs")

    texts = map_arrow(meeting(todo.where("salts = 1")), _texts, "name long, print long, n long, data binary")
    parts = scratch.keep(map_arrow(texts.repartition("name").sortWithinPartitions("name"), _settled, schema))
    scratch.sweep()
    many = todo.where("salts > 1")
    if not many.isEmpty():
        strings = map_arrow(meeting(many), _strings, "name long, salt int, print long, at binary, ids binary")
        dealt = strings.groupBy("name", "salt").agg(F.collect_list(F.struct("print", "at", "ids")).alias("runs")).select("name", "runs")
        parts = scratch.keep(parts.union(map_arrow(dealt, _repeated, schema)))
    single = todo.where("copies = 1").select("name", "print", "row", "first")
    part = parts.join(single, ["name", "print"]).select("row", (F.col("first") + F.col("start")).alias("start"), "n")
    return whole.union(part)


def dedupe(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes, kept_chars, text[, kept binary, spans array<struct<start, end>>]).

    text is what is left and kept_chars its characters, null where a cut goes through a character; kept are its bytes.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    spans = scratch.keep(repeated_starts(docs, scratch).groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("found")))
    scratch.sweep()
    both = docs.join(spans.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "found")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes long, kept_chars long, text string" + ", kept binary, spans array<struct<start:long,end:long>>" * with_kept
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "kept_chars", "text", "kept", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            gone = [removed(len(t), s) for t, s in zip(texts, batch.column(2).to_pylist())]
            kept = [cut(t, s) for t, s in zip(texts, gone)]
            left = [decoded(k) for k in kept]
            sizes = [len(k) for k in kept]
            numbers = ([len(t) for t in texts], [len(t) - n for t, n in zip(texts, sizes)], [len(s) for s in gone])
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in numbers), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            columns += [pa.array(sizes, pa.int64()), pa.array([None if x is None else len(x) for x in left], pa.int64()), pa.array(left, pa.string())]
            if with_kept:
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                columns += [pa.array(kept, pa.binary()), pa.array([[{"start": a, "end": b} for a, b in s] for s in gone], span)]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return map_arrow(both, run, schema)


def oracle() -> str:
    """The rows of ``op5_suffix_dedup`` in DuckDB's SQL; a doc_id has one row."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS x FROM (SELECT doc_id, h, unnest(range(0, n - {LENGTH - 1})) AS i FROM d WHERE n >= {LENGTH})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY x) AS c FROM w) WHERE c > 1),
b AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH}, true) AS fresh FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS z FROM (SELECT doc_id, i, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b) GROUP BY doc_id, k),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM s),
k AS (SELECT p.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS left_over FROM p JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(kept) AS kept_sha256,
       (n - n_removed)::BIGINT AS kept_bytes, length(text)::BIGINT AS kept_chars, text
FROM (SELECT *, TRY(decode(kept)) AS text FROM (SELECT d.doc_id, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, unhex(coalesce(left_over, h)) AS kept FROM d LEFT JOIN k ON d.doc_id = k.doc_id))"""
