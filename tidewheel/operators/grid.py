"""Frequency grids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def grid_shape(stats: DataFrame, nyquist_factor: float = 5, samples_per_peak: float = 5, minimum_frequency: float | None = None, maximum_frequency: float | None = None, compat: bool = True) -> DataFrame:
    """(series_id, df, nf0, nf): the automatic grid df * (nf0 + k), k < nf, of each series.

    With compat the first multiple is at most 1, however large the minimum; without, it is the least at or above 1
    that the minimum allows. A series without a baseline has no grid.
    """
    df = F.lit(1.0) / ((F.col("tmax") - F.col("tmin")) * float(samples_per_peak))
    out = stats.where("tmax > tmin").withColumn("df", df)
    pick = F.least if compat else F.greatest
    nf0 = F.lit(1) if minimum_frequency is None else pick(F.lit(1), F.floor(F.lit(float(minimum_frequency)) / F.col("df")))
    out = out.withColumn("nf0", nf0.cast("long"))
    if maximum_frequency is not None:
        nf = F.ceil(F.lit(float(maximum_frequency)) / F.col("df") - F.col("nf0"))
    else:
        nf = F.floor(F.lit(0.5 * samples_per_peak * nyquist_factor) * F.col("n"))
    return out.select("series_id", "df", "nf0", nf.cast("long").alias("nf")).where("nf > 0")


def autofrequency(stats: DataFrame, **options) -> DataFrame:
    """(series_id, k, freq)."""
    shape = grid_shape(stats, **options)
    return shape.select("series_id", "df", "nf0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nf") - 1)).alias("k")).select("series_id", "k", (F.col("df") * (F.col("nf0") + F.col("k"))).alias("freq"))


def user_grid(spark: SparkSession, freqs) -> DataFrame:
    """(k, freq) of given frequencies, for all series: a number, or numbers in lists or arrays of any shape, where k is the place in the flattened array."""
    return spark.createDataFrame([(k, float(f)) for k, f in enumerate(np.asarray(freqs, float).ravel())], "k long, freq double")


def even_grid(freqs) -> tuple[float, int, int]:
    """(step, first, count) of an even grid step * (first + k); ValueError for any other."""
    f = np.asarray(freqs, float).ravel()
    if len(f) < 2:
        raise ValueError("an even grid has two frequencies at least")
    step = float(f[1] - f[0])
    first = round(f[0] / step) if step else 0
    if not step or not np.allclose(np.diff(f), step) or not np.isclose(f[0], step * first):
        raise ValueError("frequencies are no even grid of multiples of their step")
    return step, first, len(f)


def inspect_grid(grid: DataFrame) -> DataFrame:
    """(series_id, nf, df, dnf, regular): whether the grid is even and starts at a multiple of its step."""
    w = Window.partitionBy("series_id").orderBy("k")
    steps = grid.withColumn("step", F.lead("freq").over(w) - F.col("freq"))
    shape = steps.groupBy("series_id").agg(F.count("*").alias("nf"), F.min(F.when(F.col("k") == 0, F.col("step"))).alias("df"), F.min("freq").alias("first"), F.max("step").alias("hi"), F.min("step").alias("lo"))
    near = lambda a, b: F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)
    dnf = F.floor(F.col("first") / F.col("df") + 0.5)
    even = near(F.col("hi"), F.col("df")) & near(F.col("lo"), F.col("df")) & near(F.col("first"), F.col("df") * dnf)
    return shape.select("series_id", F.col("nf").cast("long").alias("nf"), "df", dnf.cast("long").alias("dnf"), even.alias("regular"))
