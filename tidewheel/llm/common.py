"""What the operators of this subpackage share: scratch tables, Arrow plumbing, 64-bit mixing, components.

Every operator reads its rows through Spark and keeps intermediate tables in the folder named by
``spark.checkpoint.dir``, which the driver and all executors share, so a lost executor costs a re-read only.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import shared_dir

#: Rows and bytes of an Arrow batch: documents may be long, so a batch stays at some MB.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
GOLDEN = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidewheel-{uuid.uuid4().hex}"
        path = self._path(self.root)
        self._fs(path).deleteOnExit(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def new(self) -> str:
        return f"{self.root}/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, small: bool = False) -> DataFrame:
        """Write df, read it again. It goes to a third as many files as there are shuffle partitions, to an eighth if it is small beside the input.

        Every file costs a store some calls, and a local one some processes, which outweighs the tasks' start.
        """
        path, n = self.new(), partitions(self.spark)
        df.coalesce(max(8, n // 8) if small else max(12, n // 3)).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        if not small:
            del df
            self.sweep()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete kept tables that nothing reads any more, and let Spark clean shuffles that nothing refers to."""
        for t in tables:
            path = self._path(t._scratch)
            self._fs(path).delete(path, True)
        self.sweep()

    def sweep(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()


def arrow(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parquet_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Functions cached a worker process; Spark gives a worker tasks of any operator, one after the other.
CACHES: list = []


def trim() -> None:
    """Gives free memory back to the system, which a worker that waits for its next task would hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema, cached: bool = False) -> DataFrame:
    """df.mapInArrow; only tasks of functions that say so keep what earlier tasks of their worker have cached."""
    arrow(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cached:
            for cache in CACHES:
                cache.cache_clear()
        yield from fn(batches)
        trim()

    return df.mapInArrow(task, schema)


def unused(columns: list[str], *names: str) -> list[str]:
    """names, with marks before those that a table has among its columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def least_hashes(rows: DataFrame, n: int, total: int, *by: str) -> DataFrame:
    """The n of total rows with the least hashes of by. Rows far from being among them stay where they are.

    A threshold lets 1.5 n + 100 rows through on average, so that n are left but once in a great many samples; those
    few are ranked, so neither the driver nor a task gets more than that.
    """
    hashed = F.xxhash64(*by)
    if total > 3 * n + 200:
        low, span = -(1 << 63), 1 << 64
        rows = rows.where(hashed < F.lit(low + int((1.5 * n + 100) / total * span)))
    return rows.orderBy(hashed, *by).limit(n)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


# ---------------------------------------------------------------- components


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): of the edges (a, b), each node but the roots with the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (x, y, root[x], root[y]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


#: Edges that a task joins at once.
EDGES = 2_000_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): edges that join what the edges (u, v) of a task join, each node with the smallest one it reaches there."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= EDGES:
            held = [smallest_reached(*(np.concatenate(x) for x in zip(*held)))]
            n = len(held[0][0]) // 2
    if held:
        u, v = smallest_reached(*(np.concatenate(x) for x in zip(*held)))
        for k in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[k : k + (1 << 16)]), pa.array(v[k : k + (1 << 16)])], ["u", "v"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is its smallest reachable node.

    Distributed union-find. A round sends each edge to the tasks of both its ends, where each node is joined with the
    smallest one that it reaches among the task's edges, and then each of these to the task of its node alone. It ends
    when every node has one edge, to a root. Each round's edges are a written table, so neither edges nor labels reach
    the driver and lineage stays short. Rounds grow with the logarithm of the longest chain.
    """
    e = scratch.keep(map_arrow(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")), _contracted, "u long, v long"), True)
    seen = None
    while True:
        both = map_arrow(e.union(e.select("v", "u")).repartition("u"), _contracted, "u long, v long")
        new = scratch.keep(map_arrow(both.repartition("u"), _contracted, "u long, v long"), True)
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(e)
        e = new
        if state == seen:
            break
        seen = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
