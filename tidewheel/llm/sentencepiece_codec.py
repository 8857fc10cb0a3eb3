"""SentencePiece models on the tokenizers library.

The model's protobuf is read field by field; normaliser, metaspace marker, scores and byte fallback are rebuilt as a
``tokenizers`` model. Both kinds of model are supported: unigram (Viterbi over the scores) and BPE (merges rebuilt from
pieces and scores). Control, unknown, unused and byte pieces are never found in a text that spells their names;
user-defined pieces always are. Batches are encoded by the library's threads. No piece but a run of markers has a marker after
another character, so a text falls into chunks before each marker, which are encoded once each; where a vocabulary
breaks that rule, whole texts are encoded.

Edge cases: null and empty texts have no ids; a null doc_id, repeated rows and very long texts are encoded like any
other; further columns are dropped. The marker character itself decodes to a space, as in the original library.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import ChunkMemo, gather, listed
from .common import CACHES, map_arrow

#: Fixed values of the format: the marker, and the kinds of pieces and models.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Chunks that are encoded in one string, and strings in one batch.
TOGETHER = 256


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers, or the bytes of what has a length or is fixed."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            size = varint() if size is None else size
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @property
    def unk_id(self) -> int:
        return next((k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def parse(data: bytes) -> Spec:
    spec = Spec()
    for number, value in fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            spec.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    spec.kind = v
                elif n == 35:
                    spec.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    spec.charsmap = v
                elif n == 3:
                    spec.dummy_prefix = bool(v)
                elif n == 4:
                    spec.remove_extra = bool(v)
                elif n == 5:
                    spec.escape = bool(v)
    return spec


class Codec:
    """Encodes and decodes batches of texts with the model at path."""

    def __init__(self, data: bytes):
        from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers

        self.spec = spec = parse(data)
        if spec.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model kind {spec.kind} is neither unigram nor BPE")
        steps = []
        if spec.charsmap:
            steps.append(normalizers.Precompiled(spec.charsmap))
        if spec.remove_extra:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        if spec.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if spec.escape:
            steps.append(normalizers.Replace(" ", MARK))
        self.normalizer = normalizers.Sequence(steps)
        ids = {p[0]: k for k, p in enumerate(spec.pieces)}
        own = [p for p, _, k in spec.pieces if k == USER_DEFINED]
        #: The byte pieces by value, for unigram models: theirs are no pieces that a text may spell out.
        self.byte_ids = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(spec.pieces) if kind == BYTE} if spec.byte_fallback and spec.kind == UNIGRAM else {}
        if spec.kind == UNIGRAM:
            model = models.Unigram(self._unigram(), spec.unk_id, byte_fallback=False)
        else:
            model = models.BPE(ids, self._merges(ids), unk_token=spec.pieces[spec.unk_id][0], fuse_unk=True, byte_fallback=spec.byte_fallback, cache_capacity=0)
        self.tokenizer = Tokenizer(model)
        if own and spec.kind == BPE:  # they are cut out before any merge
            self.tokenizer.add_tokens([AddedToken(p, normalized=False) for p in own])
        joined = any(MARK in p.lstrip(MARK) for p, _, k in spec.pieces if k in (NORMAL, USER_DEFINED))
        self.cut = spec.escape and not joined and MARK in ids
        self.memo = ChunkMemo(self._encode_new)
        self.opens = np.array([p.startswith(MARK) for p, _, _ in spec.pieces], bool)
        self._table()

    def _unigram(self) -> list[tuple[str, float]]:
        """The pieces that a text may consist of, by id; others have a name that no text holds, and the best score, as the least one sets that of unknown characters."""
        scores = [s for _, s, k in self.spec.pieces if k == NORMAL] or [0.0]
        absent = " {}" if self.spec.escape else "\U0010ffff\ufffe\U0010fffe{}\U0010ffff"
        out = []
        for k, (piece, score, kind) in enumerate(self.spec.pieces):
            if kind == USER_DEFINED:  # fixed by the format: longer than any path of other pieces is good
                out.append((piece, len(piece.encode()) * max(scores) - 0.1))
            else:
                out.append((piece, score) if kind == NORMAL else (absent.format(k), max(scores)))
        return out

    def _merges(self, ids: dict[str, int]) -> list[tuple[str, str]]:
        found = []
        normal = {p for p, _, k in self.spec.pieces if k == NORMAL}
        for piece, score, kind in self.spec.pieces:
            if kind == NORMAL:
                found += [(-score, ids[piece[:k]], ids[piece[k:]], piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in normal and piece[k:] in normal]
        return [x[3:] for x in sorted(found)]

    def _table(self) -> None:
        out = []
        for piece, _, kind in self.spec.pieces:
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                out.append(b"")
            elif kind == UNKNOWN:
                out.append(" ⁇ ".encode())
            else:
                out.append((piece.replace(MARK, " ") if self.spec.escape else piece).encode())
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.sizes = np.array([len(x) for x in out], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _ids(self, texts: list[str]) -> list[list[int]]:
        out = []
        for k in range(0, len(texts), TOGETHER):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + TOGETHER], add_special_tokens=False)]
        if self.byte_ids:
            for k, ids in enumerate(out):
                if self.spec.unk_id in ids:
                    out[k] = self._bytes(texts[k])
        return out

    def _bytes(self, text: str) -> list[int]:
        """The ids of a text whose unknown characters become byte pieces."""
        found, out = self.tokenizer.encode(text, add_special_tokens=False), []
        for k, (a, b) in zip(found.ids, found.offsets):
            own = [self.byte_ids.get(x) for x in text[a:b].encode()] if k == self.spec.unk_id else [k]
            out += own if None not in own else [k]
        return out

    def _encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids). Chunks behind one marker are encoded many in a string: each begins at a piece with a marker."""
        plain = [self.cut and c[0] == MARK and c[1:2] != MARK for c in chunks]
        own = [c for c, ok in zip(chunks, plain) if ok]
        groups = [own[k : k + TOGETHER] for k in range(0, len(own), TOGETHER)]
        lists: list = []
        for group, ids in zip(groups, map(np.array, self._ids(["".join(g) for g in groups]))):
            cut = np.flatnonzero(self.opens[ids])
            lists += np.split(ids, cut[1:]) if len(cut) == len(group) else self._ids(group)
        found, others = iter(lists), iter(self._ids([c for c, ok in zip(chunks, plain) if not ok]))
        return listed([next(found if ok else others) for ok in plain])

    def chunks(self, text: str) -> list[str]:
        text = self.normalizer.normalize_str(text) if text else ""
        if not text:
            return []
        if not self.cut:
            return [text]
        if MARK * 2 in text:
            return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)
        first, *rest = text.split(MARK)
        return [first] * bool(first) + [MARK + x for x in rest]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.memo.encode([self.chunks(t) for t in texts])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, one a byte."""
        data = gather(self.bytes, self.starts[ids], self.sizes[ids]).tobytes()
        text = data.decode("utf-8", "replace")
        return text[1:] if self.spec.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=1)
def codec_of(data: bytes) -> Codec:
    """One a worker process, whose memo serves all its tasks."""
    return Codec(data)


CACHES.append(codec_of)


def encode_documents(docs: DataFrame, model_path: str, decode: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded): decoded is the text that the ids give back, null without ``decode``."""
    model = _model(docs, model_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            found = codec.encode([t or "" for t in batch.column(1).to_pylist()])
            lists = pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))
            texts = pa.array([codec.decode(x) for x in found] if decode else [None] * len(found), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, texts], ["doc_id", "ids", "decoded"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>, decoded string", cached=True)


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip): encodes and decodes whole texts in one pass, without moving the ids."""
    model = _model(docs, model_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = codec.encode(texts)
            same = [codec.decode(x) == t.replace(MARK, " ") for x, t in zip(found, texts)]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_crc32 long, round_trip boolean", cached=True)


def _model(docs: DataFrame, path: str) -> bytes:
    """The model file's bytes, which travel with the tasks: executors need not have the file."""
    with open(path, "rb") as f:
        return f.read()
