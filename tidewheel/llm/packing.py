"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` ids. Only the histogram of piece lengths (at most ``capacity``
rows, whatever the corpus) reaches the driver, where each bin is planned by a bitset subset-sum over the lengths that
are left: the longest piece and the fullest feasible combination beside it. A combination found is used as often as its lengths last, so planning
depends on the number of different lengths, not of documents. Pieces then find their place by their rank among the
pieces of their length, without a global sort.

Edge cases: a null or empty text is its end mark alone; longer documents are cut, nothing is dropped; a null doc_id is
carried along; repeated rows are packed each by itself; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .chunks import ChunkMemo, gather, listed, split, strings_of
from .common import CACHES, Scratch, map_arrow

CAPACITY = 4096
END_ID = 1
#: Plain words that are encoded in one string.
TOGETHER = 512
#: Different words and marks that a worker remembers.
STEMS = 600_000
#: What may follow a plain word and is cut from it: ASCII marks but the apostrophe, which can begin a suffix.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LATIN = [chr(c) for c in range(0x80, 0x100) if chr(c).isalpha()]


class WordTokenizer:
    """Encodes chunks between white space, for a tokenizer that drops white space, lower-cases and marks where words end.

    A chunk of Latin letters and marks after them is two pieces to the tokenizer, so the word is encoded in lower case
    and apart from its marks. Plain words are encoded many at a time, as each ends in a marked token, and by the model
    alone, as normalising leaves them as they are; ``_plain_agrees`` tells whether it does. Other chunks are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for w, k in vocab.items() if w.endswith("</w>")]] = True
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in LATIN}
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.stems = ChunkMemo(self.encode_stems, STEMS)
        self.plain = self._plain_agrees()

    def _plain_agrees(self) -> bool:
        """Whether words of letters, in either case and with marks, give what their lower-case pieces give."""
        letters = [chr(c) for c in range(97, 123)] + [c.lower() for c in LATIN]
        words = [x + y + "e" for x in letters for y in letters]
        shown = [w.upper() if w.upper().lower() == w and "ß" not in w else w for w in words]
        sizes, ids = listed(self._ids([w + " " + w + MARKS for w in shown]))
        marks = self._ids([MARKS])[0]
        expected = [x + x + marks for x in map(np.ndarray.tolist, split(*self._words(words)))]
        return [x.tolist() for x in split(sizes, ids)] == expected

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes, flat = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for k in range(0, len(words), TOGETHER):
            own = words[k : k + TOGETHER]
            text = " ".join(own)
            text = text if text.isascii() else text.translate(self.bytes)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            n, ids = (np.diff(cut, prepend=0), ids) if len(cut) == len(own) and cut[-1] == len(ids) else listed(self._ids(own))
            sizes.append(n)
            flat.append(ids)
        return np.concatenate(sizes), np.concatenate(flat)

    def encode_stems(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([self.plain and p.isalpha() and p == p.lower() and (p.isascii() or max(p) <= "\xff") for p in pieces], bool)
        both = (self._words([p for p, ok in zip(pieces, plain) if ok]), listed(self._ids([p for p, ok in zip(pieces, plain) if not ok])))
        sizes, flat = (np.concatenate(x) for x in zip(*both))
        back = np.argsort(np.argsort(~plain, kind="stable"), kind="stable")
        return sizes[back], gather(flat, (np.cumsum(sizes) - sizes)[back], sizes[back])

    def chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids one after the other) of different chunks: a plain word in lower case and the marks after it, others whole."""
        first, marks = chunks, np.zeros(len(chunks), np.int64)
        if self.plain and len(chunks):
            word = pc.utf8_rtrim(chunks, MARKS)
            alpha = pc.utf8_is_alpha(word).to_numpy(zero_copy_only=False)
            beyond = np.flatnonzero(alpha & ~pc.string_is_ascii(word).to_numpy(zero_copy_only=False))
            alpha[beyond] = [max(w) <= "\xff" for w in strings_of(word.take(pa.array(beyond)))]
            first = pc.if_else(pa.array(alpha), pc.utf8_lower(word), chunks)
            marks = np.where(alpha, (pc.binary_length(chunks).to_numpy() - pc.binary_length(word).to_numpy()), 0)
        ends = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset + 1 : chunks.offset + len(chunks) + 1].astype(np.int64)
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
        offsets = np.concatenate([[0], np.cumsum(marks)]).astype(np.int32)
        tails = pa.StringArray.from_buffers(len(chunks), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(gather(data, ends - marks, marks))))
        both = pa.concat_arrays([first, tails]).dictionary_encode()
        return self.stems.flat_of(strings_of(both.dictionary), both.indices.to_numpy().reshape(2, -1).T.ravel(), np.full(len(chunks), 2))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array.

        Chunks, and the words in them, are cut and told apart by Arrow, so each word is looked up once a batch. At a
        text's ends a chunk may be empty, which has no ids.
        """
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = cut.flatten().dictionary_encode()
        sizes, ids = self.chunk_ids(words.dictionary)
        at, own = words.indices.to_numpy(), np.diff(cut.offsets.to_numpy())
        upto = np.concatenate([[0], np.cumsum(sizes[at])])[np.concatenate([[0], np.cumsum(own)])]
        return split(np.diff(upto), gather(ids, (np.cumsum(sizes) - sizes)[at], sizes[at]))


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One a worker process, whose memo serves all its tasks."""
    return WordTokenizer(path)


CACHES.append(word_tokenizer)


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth[, ids]): nth counts the pieces of this length in the task before."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, seen = word_tokenizer(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows: list[tuple] = []
            for doc, tokens in enumerate(words.encode(batch.column(1))):
                tokens = np.concatenate([tokens, end]).astype("<u4")
                for piece, start in enumerate(range(0, len(tokens), capacity)):
                    own = tokens[start : start + capacity]
                    rows.append((doc, piece, start, len(own), zlib.crc32(own.tobytes()), part, int(seen[len(own)]), *([own.astype(np.int64)] if with_ids else [])))
                    seen[len(own)] += 1
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
            at, *columns = list(zip(*rows)) or [()] * (7 + with_ids)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names[: len(columns) + 1])

    return map_arrow(docs.select("doc_id", "text"), run, schema, cached=True)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """[(length, how often)] with the largest sum up to room, by subset-sum over a bitset of reachable sums."""
    reach, steps, every = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            new = reach | (reach << (k * length)) & every
            if new != reach:
                steps.append((length, k, reach))
                reach = new
            left -= k
            k *= 2
        if reach >> room:
            break
    want, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> want & 1:
            want -= k * length
            used[length] = used.get(length, 0) + k
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern, times)]: bins by minimum slack, each around the longest piece left."""
    counts, out = dict(counts), []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = dict(fullest({k: n for k, n in counts.items() if n}, capacity - longest))
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((sorted(pattern.items(), reverse=True), times))
    return out


def places(patterns: list[tuple[list[tuple[int, int]], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: the piece of rank first + i goes to sequence + i at offset."""
    rank = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, n in pattern:
            for _ in range(n):
                rows.append((length, rank[length], sequence, offset))
                rank[length] += times
                offset += length
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return {"key": (table[:, 0] << 48) | table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of every document."""
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.keep(tokenize(docs, tokenizer_path, capacity, end_id, with_ids))
    tally = pieces.groupBy("part", "length").count()
    before = tally.select("part", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(plan(lengths, capacity), capacity)
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*names, *["ids"] * with_ids, "rank")
    out = T.StructType([*(ranked.schema[n] for n in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), *([ranked.schema["ids"]] if with_ids else [])])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(where["key"], (length << 48) | rank, "right") - 1
            first = where["key"][at] & ((1 << 48) - 1)
            own = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(where["sequence"][at] + rank - first), pa.array(where["offset"][at]), *([batch.column("ids")] if with_ids else [])], out.names)

    return map_arrow(ranked, put, out)
