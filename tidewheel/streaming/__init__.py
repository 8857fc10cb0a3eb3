"""Searches over streams of observations.

At fixed frequencies a search needs a few sums of each series, which add up, so they are kept as the state of a
streaming aggregation: ``running_sums`` over all observations so far (update or complete mode), ``windowed_sums`` over
windows of event time behind a watermark (append mode too), after which late observations are dropped. ``fits_of`` turns
a batch of such sums into the best fits, in ``foreachBatch`` or on what a sink has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernel import best_phase
from ..operators.prepare import inverse_variance
from ..operators.sums import TWO_PI
from ..operators.templates import Template

FIT = "power double, a double, b double, c double, sgn double, theta double"


def _sums(harmonics: int) -> list[Column]:
    om, y = inverse_variance(), F.col("y")
    x = F.lit(TWO_PI) * F.col("freq") * F.col("t")
    out = [F.count("*").alias("n"), F.sum(om).alias("w"), F.sum(om * y).alias("wy"), F.sum(om * y * y).alias("wyy")]
    for h in range(1, 2 * harmonics + 1):
        out += [F.sum(om * F.cos(x * float(h))).alias(f"wc{h}"), F.sum(om * F.sin(x * float(h))).alias(f"ws{h}")]
    for h in range(1, harmonics + 1):
        out += [F.sum(om * y * F.cos(x * float(h))).alias(f"wyc{h}"), F.sum(om * y * F.sin(x * float(h))).alias(f"wys{h}")]
    return out


def _at(obs: DataFrame, freqs) -> DataFrame:
    return obs.withColumn("freq", F.explode(F.array(*(F.lit(float(f)) for f in np.asarray(freqs, float).ravel()))))


def running_sums(obs: DataFrame, freqs, harmonics: int) -> DataFrame:
    """(series_id, freq, n, w, wy, wyy, wc1, ws1, ..., wyc1, wys1, ...) of all observations (series_id, t, y, dy) so far."""
    return _at(obs, freqs).groupBy("series_id", "freq").agg(*_sums(harmonics))


def windowed_sums(obs: DataFrame, freqs, harmonics: int, time: str, width: str, late: str) -> DataFrame:
    """``running_sums`` of each window of width of the event time, which also has a column window; what comes more than late after the latest is dropped."""
    rows = _at(obs.withWatermark(time, late), freqs)
    return rows.groupBy(F.window(time, width).alias("window"), "series_id", "freq").agg(*_sums(harmonics))


def fits_of(sums: DataFrame, template: Template) -> DataFrame:
    """The keys of sums (window, series_id, freq) with n, power, a, b, c, sgn, theta; power is null where no fit is defined."""
    h = len(template.c)
    keys = [c for c in ("window", "series_id", "freq", "n") if c in sums.columns]
    columns = [f"wc{k}" for k in range(1, 2 * h + 1)] + [f"ws{k}" for k in range(1, 2 * h + 1)] + [f"wyc{k}" for k in range(1, h + 1)] + [f"wys{k}" for k in range(1, h + 1)]
    out = T.StructType([*(sums.schema[c] for c in keys), *T._parse_datatype_string(FIT).fields])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w, wy, wyy, *parts = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("w", "wy", "wyy", *columns))
                mean = wy / w
                parts = np.stack(parts, axis=1) / w[:, None]
                parts[:, 4 * h : 5 * h] -= mean[:, None] * parts[:, :h]
                parts[:, 5 * h :] -= mean[:, None] * parts[:, 2 * h : 3 * h]
                got = best_phase(parts, template.c, template.s, mean, np.maximum(wyy / w - mean**2, 0))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *(pa.array(got[:, k], pa.float64(), from_pandas=True) for k in range(6))], out.names)

    return sums.select(*keys, "w", "wy", "wyy", *columns).mapInArrow(solve, out)
