"""Weights, weighted moments, validation and phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def inverse_variance(dy: str | Column = "dy") -> Column:
    """Null for an error of zero, so that no sum counts the row."""
    d = F.col(dy) if isinstance(dy, str) else dy
    return F.when(d != 0, F.lit(1.0) / (d * d))


def series_stats(obs: DataFrame) -> DataFrame:
    """(series_id, n, tmin, tmax, wsum, ybar, yy, chi2_ref): two aggregations, so the moments are centred.

    Both combine on the map side, so one very long series doesn't burden one task.
    """
    w = inverse_variance()
    first = obs.groupBy("series_id").agg(F.count("*").alias("n"), F.min("t").alias("tmin"), F.max("t").alias("tmax"), F.sum(w).alias("wsum"), (F.sum(w * F.col("y")) / F.sum(w)).alias("ybar"))
    centred = obs.join(first, "series_id")
    second = centred.groupBy(*first.columns).agg(F.sum(w * (F.col("y") - F.col("ybar")) ** 2).alias("chi2_ref"))
    return second.select(*first.columns, (F.col("chi2_ref") / F.col("wsum")).alias("yy"), "chi2_ref")


def weighted(obs: DataFrame, stats: DataFrame | None = None, *more: str) -> DataFrame:
    """obs with w (adding up to 1 in a series), yc = y less the weighted mean, and more columns of stats."""
    stats = series_stats(obs) if stats is None else stats
    return obs.join(stats.select("series_id", "wsum", "ybar", *more), "series_id").select("series_id", *more, "t", "y", "dy", (inverse_variance() / F.col("wsum")).alias("w"), (F.col("y") - F.col("ybar")).alias("yc"))


def order_violations(obs: DataFrame, ordinal: str) -> DataFrame:
    """(series_id, n_violations): times that are smaller than the one before them; equal times are allowed."""
    before = F.lag("t").over(Window.partitionBy("series_id").orderBy(ordinal))
    return obs.withColumn("bad", (before > F.col("t")).cast("long")).groupBy("series_id").agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("n_violations"))


def phase(t: str | Column, freq: str | Column) -> Column:
    x = (F.col(t) if isinstance(t, str) else t) * (F.col(freq) if isinstance(freq, str) else freq)
    return x - F.floor(x)
