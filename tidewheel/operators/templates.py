"""Templates: truncated Fourier series without a constant, of unit norm."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TWO_PI = 2 * math.pi


@dataclass(frozen=True)
class Template:
    """Immutable; c and s are normalised on creation."""

    c: tuple[float, ...]
    s: tuple[float, ...]
    template_id: str | None = None

    def __post_init__(self):
        c, s = np.broadcast_arrays(np.asarray(self.c, float), np.asarray(self.s, float))
        if c.ndim != 1:
            raise ValueError("coefficients must be one-dimensional")
        norm = math.sqrt(float((c**2 + s**2).sum()))
        if not norm > 0:
            raise ValueError("a template needs a coefficient that is not zero")
        object.__setattr__(self, "c", tuple((c / norm).tolist()))
        object.__setattr__(self, "s", tuple((s / norm).tolist()))

    @classmethod
    def from_sampled(cls, y, nharmonics: int | float = 0.9, template_id: str | None = None) -> Template:
        """From values at phases n/N: a number of harmonics, or the share of variance that they are to explain."""
        y = np.asarray(y, float)
        n, ks = len(y), np.arange(1, len(y) // 2 + 1)
        angle = TWO_PI * np.outer(ks, np.arange(n)) / n
        c, s = 2 / n * np.cos(angle) @ y, 2 / n * np.sin(angle) @ y
        if 0 < nharmonics < 1:
            power = np.cumsum(c**2 + s**2)
            nharmonics = max(1, int((power < nharmonics * power[-1]).sum()))
        return cls(tuple(c[: int(nharmonics)]), tuple(s[: int(nharmonics)]), template_id)

    def __call__(self, phase):
        h = np.arange(1, len(self.c) + 1)
        x = TWO_PI * np.asarray(phase, float)[..., None] * h
        return np.cos(x) @ np.asarray(self.c) + np.sin(x) @ np.asarray(self.s)

    @property
    def odd_only(self) -> bool:
        return not any(self.c[1::2]) and not any(self.s[1::2])


def template_table(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(ordinal, template_id, n, c, s): a row a harmonic."""
    rows = [(k, t.template_id or f"t{k}", n, c, s) for k, t in enumerate(templates) for n, (c, s) in enumerate(zip(t.c, t.s), 1)]
    return spark.createDataFrame(rows, "ordinal int, template_id string, n int, c double, s double")


def normalised(coefficients: DataFrame) -> DataFrame:
    """(template_id, n, c, s) of unit norm; templates of norm zero are dropped."""
    norm = F.sqrt(F.sum(F.col("c") ** 2 + F.col("s") ** 2).over(Window.partitionBy("template_id")))
    return coefficients.withColumn("norm", norm).where("norm > 0").select("template_id", "n", (F.col("c") / F.col("norm")).alias("c"), (F.col("s") / F.col("norm")).alias("s"))


def fourier(samples: DataFrame) -> DataFrame:
    """(template_id, n, c, s), not normalised, of samples (template_id, idx, val) at phases idx / N, harmonics to N/2."""
    size = samples.groupBy("template_id").agg(F.count("*").alias("size"))
    rows = samples.join(size, "template_id").withColumn("n", F.explode(F.sequence(F.lit(1), F.expr("CAST(size DIV 2 AS INT)"))))
    angle = F.lit(TWO_PI) * F.col("n") * F.col("idx") / F.col("size")
    part = lambda f: (F.lit(2.0) / F.max("size") * F.sum(F.col("val") * f(angle)))
    return rows.groupBy("template_id", "n").agg(part(F.cos).alias("c"), part(F.sin).alias("s"))


def from_sampled(samples: DataFrame, nharmonics: int | float = 0.9) -> DataFrame:
    """(template_id, n, c, s): templates of sampled shapes, with a number of harmonics or a share of the variance."""
    table = fourier(samples)
    if 0 < nharmonics < 1:
        w = Window.partitionBy("template_id")
        power = F.col("c") ** 2 + F.col("s") ** 2
        table = table.withColumn("cum", F.sum(power).over(w.orderBy("n"))).withColumn("all", F.sum(power).over(w))
        table = table.withColumn("h", F.greatest(F.lit(1), F.count(F.when(F.col("cum") < F.lit(float(nharmonics)) * F.col("all"), 1)).over(w)))
        table = table.where("n <= h").select("template_id", "n", "c", "s")
    else:
        table = table.where(F.col("n") <= int(nharmonics))
    return normalised(table)


def value_at(phase: Column, template: Template) -> Column:
    """The template's value as one expression."""
    out = F.lit(0.0)
    for n, (c, s) in enumerate(zip(template.c, template.s), 1):
        x = F.lit(TWO_PI * n) * phase
        out = out + F.lit(c) * F.cos(x) + F.lit(s) * F.sin(x)
    return out


def mixed(first: Template, second: Template, share: float, nharmonics: int | float = 0.9, size: int = 100) -> Template:
    """share of the first plus the rest of the second, sampled and made a template again."""
    at = np.arange(size) / size
    return Template.from_sampled(share * first(at) + (1 - share) * second(at), nharmonics)
