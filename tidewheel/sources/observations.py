"""Observations: series_id (of any type; integers become long), t (days), y, dy, all double but the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def observations(df: DataFrame, series: str | Column, t: str | Column, y: str | Column, dy: str | Column | None = None) -> DataFrame:
    """Rows without id, t or y are dropped, and those whose dy is zero or no number, as they have no weight; a missing dy counts as 1."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    err = F.lit(1.0) if dy is None else F.coalesce(col(dy).cast("double"), F.lit(1.0))
    key = df.select(col(series).alias("series_id")).schema[0].dataType
    own = col(series).cast("long") if isinstance(key, T.IntegralType) else col(series)
    out = df.select(own.alias("series_id"), col(t).cast("double").alias("t"), col(y).cast("double").alias("y"), err.alias("dy"))
    return out.where("series_id is not null and t is not null and y is not null and not isnan(t) and not isnan(y) and dy <> 0 and not isnan(dy)")


def days(ts: str, origin: str = "2024-01-01") -> Column:
    """A timestamp as days since origin; subtracting first keeps the digits of later phases."""
    return F.expr(f"CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{origin} 00:00:00', {ts}) AS DOUBLE) / 86400000000D")


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, a series a user, with unequal errors made of the event's number."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return observations(events, "user_id", days("ts"), "value", F.lit(1.0) + F.lit(0.25) * (F.col("event_id") % 5))


def order_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table, a series a customer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return observations(orders, "o_custkey", F.datediff("o_orderdate", F.lit("1992-01-01")), "o_totalprice")
