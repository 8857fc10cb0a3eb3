"""Weighted trigonometric sums of each series at each trial frequency."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TWO_PI = 2 * math.pi
#: Rows up to which a grid for all series is sent to every task.
SMALL_GRID = 100_000


def for_all(grid: DataFrame) -> DataFrame:
    """The grid with a hint to broadcast it, if it is counted to be small; a larger one is joined as Spark sees fit."""
    return F.broadcast(grid) if grid.limit(SMALL_GRID + 1).count() <= SMALL_GRID else grid


def direct_sums(weighted: DataFrame, grid: DataFrame, harmonics: int) -> DataFrame:
    """(series_id, freq, c1..c2H, s1..s2H, yc1..ycH, ys1..ysH).

    Sums at 2H harmonics give every product sum by identities, so 6H sums do instead of about 4H^2. The grid is joined
    on series_id if it has one, else it is one small grid for all. Aggregation combines on the map side.
    """
    rows = weighted.join(grid, "series_id") if "series_id" in grid.columns else weighted.crossJoin(for_all(grid))
    x = F.lit(TWO_PI) * F.col("freq") * F.col("t")
    sums = []
    for h in range(1, 2 * harmonics + 1):
        sums += [F.sum(F.col("w") * F.cos(x * float(h))).alias(f"c{h}"), F.sum(F.col("w") * F.sin(x * float(h))).alias(f"s{h}")]
    for h in range(1, harmonics + 1):
        sums += [F.sum(F.col("w") * F.col("yc") * F.cos(x * float(h))).alias(f"yc{h}"), F.sum(F.col("w") * F.col("yc") * F.sin(x * float(h))).alias(f"ys{h}")]
    return rows.groupBy("series_id", "freq").agg(*sums)


def covariances(harmonics: int) -> dict[str, str]:
    """SQL expressions of cc, cs and ss for each pair of harmonics, by product-to-sum identities."""
    c = lambda h: "CAST(1 AS DOUBLE)" if h == 0 else f"c{h}"
    s = lambda h: "CAST(0 AS DOUBLE)" if h == 0 else f"s{h}"
    out = {}
    for j in range(1, harmonics + 1):
        for k in range(1, harmonics + 1):
            d, sign = abs(k - j), "-" if k < j else "+"
            out[f"cc{j}{k}"] = f"CAST(0.5 AS DOUBLE) * ({c(d)} + {c(j + k)}) - c{j} * c{k}"
            out[f"cs{j}{k}"] = f"CAST(0.5 AS DOUBLE) * ({s(j + k)} {sign} {s(d)}) - c{j} * s{k}"
            out[f"ss{j}{k}"] = f"CAST(0.5 AS DOUBLE) * ({c(d)} - {c(j + k)}) - s{j} * s{k}"
    return out


def with_covariances(sums: DataFrame, harmonics: int) -> DataFrame:
    return sums.select("*", *(F.expr(e).alias(n) for n, e in covariances(harmonics).items()))


def fast_sums(obs: DataFrame, grid: DataFrame, harmonics: int, stats: DataFrame) -> DataFrame:
    """``direct_sums`` at the even grids of ``grid_shape``, by fast transforms: harmonics * (n + nf log nf) steps a series instead of harmonics * n * nf."""
    from .fit import Block, Held, block_sums, by_block, spread

    names = [f"{x}{h}" for h in range(1, 2 * harmonics + 1) for x in "cs"] + [f"y{x}{h}" for h in range(1, harmonics + 1) for x in "cs"]
    place = {"c": 0, "s": 2 * harmonics, "yc": 4 * harmonics, "ys": 5 * harmonics}
    order = [place[n.rstrip("0123456789")] + int(n.lstrip("ycs")) - 1 for n in names]
    out = T.StructType([obs.schema["series_id"], T.StructField("freq", T.DoubleType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def take(block: Block, t: np.ndarray, w: np.ndarray, yc: np.ndarray, times: np.ndarray) -> np.ndarray:
        return block_sums(block, t, w, yc, harmonics, always=True)

    def emit(series: pa.Array, held: Held) -> Iterator[pa.RecordBatch]:
        at, _, f, total, *_ = spread(held)
        yield pa.RecordBatch.from_arrays([series.take(pa.array(at)), pa.array(f), *(pa.array(total[:, k]) for k in order)], out.names)

    return by_block(obs, grid, stats, out, take, emit)
