"""Tokenising by chunk: a chunk that the tokenizer never joins with its neighbours is encoded once and looked up after.

Natural text repeats its words, so a bounded memo of chunk -> ids saves most of the tokenizer's work; ids of a whole
batch are then gathered with numpy. The memo starts afresh beyond ``limit`` chunks, so a worker's memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class _Numbers(dict):
    """Numbers keys in order of their first look-up."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


def gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[first : first + size], one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(first - (ends - sizes), sizes) + np.arange(total)]


def split(sizes: np.ndarray, flat: np.ndarray) -> list[np.ndarray]:
    """The runs of flat, of the given sizes."""
    ends = np.cumsum(sizes)
    return [flat[a:b] for a, b in zip(ends - sizes, ends)]


def listed(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids one after the other)."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))


def strings_of(column: pa.Array) -> list[str]:
    """The strings of a column, none of which has a line feed: cut out of one, which takes far less time than one by one."""
    if not len(column):
        return []
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), "\n")
    return whole[0].as_py().split("\n")


class ChunkMemo:
    """ids of lists of chunks; encode_new(chunks) gives (sizes, ids) of chunks, each encoded alone."""

    def __init__(self, encode_new: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 250_000):
        self.encode_new, self.limit = encode_new, limit
        self.clear()

    def clear(self) -> None:
        self.at = _Numbers()
        self.flat_ids = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.known = 0

    def _learn(self) -> None:
        chunks, self.at.new = self.at.new, []
        sizes, new = self.encode_new(chunks)
        base = int(self.starts[self.known])
        while self.known + len(chunks) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while base + len(new) > len(self.flat_ids):
            self.flat_ids = np.concatenate([self.flat_ids, np.zeros_like(self.flat_ids)])
        self.flat_ids[base : base + len(new)] = new
        self.starts[self.known + 1 : self.known + 1 + len(chunks)] = base + np.cumsum(sizes)
        self.known += len(chunks)

    def flat(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, ids one after the other); a text is given as its chunks."""
        self._room()
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        return self._gathered(self._numbers(chain.from_iterable(texts), int(counts.sum())), counts)

    def flat_of(self, chunks: list, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``flat`` of texts whose chunks are given by their numbers at in a list of different ones, and how many each text has."""
        self._room()
        return self._gathered(self._numbers(chunks, len(chunks))[at], counts)

    def _room(self) -> None:
        if len(self.at) > self.limit:
            self.clear()

    def _numbers(self, chunks: Iterable, n: int) -> np.ndarray:
        at = np.fromiter(map(self.at.__getitem__, chunks), np.int64, n)
        if self.at.new:
            self._learn()
        return at

    def _gathered(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.starts[at]
        sizes = self.starts[at + 1] - first
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return np.diff(upto), gather(self.flat_ids, first, sizes)

    def encode(self, texts: list[list]) -> list[np.ndarray]:
        """The ids of each text, which is given as its chunks."""
        return split(*self.flat(texts))
