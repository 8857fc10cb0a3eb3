"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample (``sample`` rows, those with the smallest hashes, but at most
``SAMPLE_BYTES`` of vectors in the table's own float type) on the driver, which works through it in blocks and so holds
little besides the sample. Every row is indexed. A search probes the nearest cells, ranks their rows by asymmetric distance tables and reranks the
best by the exact distance in double precision. Rows of a cell lie in blocks of about ``ROWS``, so a cell that holds a
third of all rows is spread over many tasks. Blocks are dealt out to groups of about ``GROUP_BYTES``; the blocks of a
group and the queries that probe any of them are sorted into one task, the rows first, and the queries stream past. So a
query is copied to groups rather than cells, and neither side is broadcast or gathered in a row.

Equal vectors share their distances: of each, the k + 1 smallest vec_ids are indexed, which is all that a search for k
neighbours other than the query can return, and equal queries are searched once.

Edge cases: rows with a null vec_id, and vectors that are null, zero, of another length than the most common one, or
hold null or non-finite components take no part, neither as query nor as candidate. Repeated rows count once. With
fewer candidates than k all are returned; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, least_hashes, map_arrow

SAMPLE, SAMPLE_BYTES = 10_000, 64 << 20
#: Rows of the sample that are compared with the centroids at once.
FIT_ROWS = 512
MAX_CELLS = 1024
SUBSPACES = 16
CODES = 256
#: Rows of a block, share of cells probed (at least LEAST_PROBES), rows reranked for each neighbour.
ROWS, PROBED, LEAST_PROBES, RERANK = 4096, 0.6, 32, 25
#: Bytes of a group's vectors and codes, and groups at least.
GROUP_BYTES, GROUPS = 64 << 20, 64


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's centroids; an empty cell takes the point farthest from its own. Besides x, only blocks and centroids are held."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    far = np.empty(len(x))
    for _ in range(rounds):
        n, sums = np.zeros(len(c), np.int64), np.zeros(c.shape)
        for a in range(0, len(x), FIT_ROWS):
            some = x[a : a + FIT_ROWS].astype(np.float64)
            d = nearest_table(some, c)
            own, far[a : a + FIT_ROWS] = d.argmin(axis=1), d.min(axis=1)
            order = np.argsort(own, kind="stable")
            cells, cut, counts = np.unique(own[order], return_index=True, return_counts=True)
            sums[cells] += np.add.reduceat(some[order], cut)
            n[cells] += counts
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return c


def cells_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest c of every x, block by block."""
    return np.concatenate([nearest_table(x[a : a + FIT_ROWS].astype(np.float64), c).argmin(axis=1) for a in range(0, len(x), FIT_ROWS)])


def nearest_table(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every x to every c."""
    return (x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)[None, :]


@dataclass
class Quantiser:
    centroids: np.ndarray
    parts: list[np.ndarray]  # columns of each subspace
    books: list[np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, cells: int) -> Quantiser:
        centroids = kmeans(x, cells)
        own = cells_of(x, centroids)
        parts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        return Quantiser(centroids, parts, [kmeans(x[:, p] - centroids[:, p][own], CODES, 8) for p in parts])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of every row."""
        cell = nearest_table(x, self.centroids).argmin(axis=1)
        left = x - self.centroids[cell]
        return cell, np.stack([nearest_table(left[:, p], b).argmin(axis=1) for p, b in zip(self.parts, self.books)], axis=1).astype(np.uint8)

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric: exact query against quantised rows of a cell."""
        left = q - self.centroids[cell]
        out = np.zeros(len(codes))
        for k, (p, b) in enumerate(zip(self.parts, self.books)):
            out += ((b - left[p]) ** 2).sum(axis=1)[codes[:, k]]
        return out


def usable(vector: str, size: int) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == size) & finite & F.exists(v, lambda x: x != 0)


def sample_rows(sample: int, dim: int, kind: str) -> int:
    """Rows that the quantisers are fitted on: sample, or as many as SAMPLE_BYTES hold."""
    return max(1, min(sample, SAMPLE_BYTES // (dim * (4 if kind == "float" else 8))))


def search(rows: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", sample: int = SAMPLE, probed: float = PROBED, rerank: int = RERANK, least_probes: int = LEAST_PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row that is_query holds for."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "float" if rows.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    rows = rows.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), is_query.alias("is_query"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes or not sizes[0]["d"]:
        return empty
    dim = sizes[0]["d"]
    rows = rows.where(usable("v", dim))
    total = rows.count()
    if not total:
        return empty
    chosen = least_hashes(rows.select("vec_id", "v"), sample_rows(sample, dim, kind), total, "vec_id")
    points = _matrix(chosen.select(F.transform("v", lambda x: x.cast(kind))).toArrow().column(0).combine_chunks())
    coder = Quantiser.fit(points, int(min(MAX_CELLS, max(1, math.sqrt(total)))))
    del points

    # Of equal vectors the k + 1 smallest ids are enough; the window's limit is taken before the shuffle as well.
    ranked = rows.select("vec_id", "v").distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    index = scratch.keep(_encoded(ranked.select("vec_id", "v"), coder))
    cells = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    salts = F.element_at(F.create_map(*(F.lit(x) for c, n in cells.items() for x in (c, -(-n // ROWS)))), F.col("cell"))
    salt = F.pmod(F.xxhash64("vec_id"), salts).cast("int")
    groups = max(GROUPS, -(-sum(cells.values()) * (8 * dim + 32) // GROUP_BYTES))
    held = index.select(F.pmod(F.col("cell") + salt, F.lit(groups)).alias("part"), F.lit(False).alias("asks"), "cell", salt.alias("salt"), F.col("vec_id").alias("id"), "codes", "vec")

    asked = rows.where("is_query").select("vec_id", "v").distinct()
    distinct = scratch.keep(asked.groupBy("v").agg(F.min("vec_id").alias("query")), True)
    probes = _probes(distinct, coder, cells, groups, k, probed, least_probes)
    asking = probes.select("part", F.lit(True), F.lit(0), F.lit(0), "query", "blocks", "vec")
    near = _near(held.union(asking).repartition("part").sortWithinPartitions("part", "asks", "cell", "salt"), coder, k + 1, rerank)
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
    found = asked.join(distinct, "v").select(F.col("vec_id").alias("query_id"), "query").join(best.select("query", "vec_id", "score").hint("merge"), "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _encoded(rows: DataFrame, coder: Quantiser) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                cell, codes = coder.encode(x)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes]), pa.array([v.tobytes() for v in x])], ["cell", "vec_id", "codes", "vec"])

    return map_arrow(rows, run, "cell int, vec_id long, codes binary, vec binary")


def _probes(queries: DataFrame, coder: Quantiser, cells: dict[int, int], groups: int, k: int, probed: float, least_probes: int) -> DataFrame:
    """(part, query, blocks, vec): by group, the (cell, salt) of all blocks of each query's nearest cells, until enough are probed and they hold some times k rows."""
    counts = np.array([cells.get(c, 0) for c in range(len(coder.centroids))])
    least = max(least_probes, int(np.ceil(probed * len(counts))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, ids = _matrix(batch.column(0)), batch.column(1).to_numpy()
                order = np.argsort(nearest_table(x, coder.centroids), axis=1, kind="stable")
                held = np.cumsum(counts[order], axis=1) - counts[order]
                use = ((np.arange(len(counts)) < least) | (held < 5 * (k + 1))) & (counts[order] > 0)
                vecs = pa.array([v.tobytes() for v in x], pa.binary())
                for q, own in enumerate(use):
                    cell = order[q, own]
                    salts = -(-counts[cell] // ROWS)
                    salt = np.arange(salts.sum()) - np.repeat(np.cumsum(salts) - salts, salts)
                    blocks = np.stack([np.repeat(cell, salts), salt], axis=1).astype(np.int32)
                    part = blocks.sum(axis=1) % groups
                    own = np.unique(part)
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), ids[q])), pa.array([blocks[part == g].tobytes() for g in own], pa.binary()), vecs.take(pa.array(np.full(len(own), q)))], ["part", "query", "blocks", "vec"])

    return map_arrow(queries, run, "part int, query long, blocks binary, vec binary")


def _near(meeting: DataFrame, coder: Quantiser, k: int, rerank: int) -> DataFrame:
    """(query, vec_id, score): the k nearest rows of each group for each query that probes it. Rows come before queries."""

    def vectors(column: pa.Array, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], axis=1)
            cut = np.concatenate([[0], np.flatnonzero((kinds[1:] != kinds[:-1]).any(axis=1)) + 1, [len(kinds)]])
            for a, b in zip(cut[:-1], cut[1:]):
                ids, codes, vec = (batch.column(c).slice(a, b - a) for c in (4, 5, 6))
                if kinds[a, 0] != part:
                    part, held = kinds[a, 0], {}
                if not kinds[a, 1]:
                    held.setdefault((int(kinds[a, 2]), int(kinds[a, 3])), []).append((ids.to_numpy(), vectors(codes, np.uint8), vectors(vec, np.float64)))
                    continue
                for key, pieces in held.items():
                    if len(pieces) > 1:
                        held[key] = [tuple(np.concatenate(x) for x in zip(*pieces))]
                found = [nearest(query, q, [(key[0], *held[key][0]) for key in map(tuple, np.frombuffer(blocks, np.int32).reshape(-1, 2).tolist()) if key in held]) for query, q, blocks in zip(ids.to_numpy(), vectors(vec, np.float64), codes.to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*found)], ["query", "vec_id", "score"])

    def nearest(query: int, q: np.ndarray, blocks: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = [(np.empty(0, np.int64), np.empty(0))]
        for cell, ids, codes, x in blocks:
            some = np.arange(len(ids))
            if len(ids) > rerank * k:
                some = np.argpartition(coder.distances(q, cell, codes), rerank * k)[: rerank * k]
            out.append((ids[some], np.sqrt(((x[some] - q) ** 2).sum(axis=1))))
        ids, score = (np.concatenate(z) for z in zip(*out))
        best = np.lexsort((ids, score))[:k]
        return np.full(len(best), query), ids[best], score[best]

    return map_arrow(meeting, run, "query long, vec_id long, score double")
