"""Fits of templates to series at trial frequencies: exact by kernel, on a grid of phases, and closed forms."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.kernel import FAST_FROM, best_phase, direct_slow_chi2, grid_sums, least_slow_chi2, slow_chi2, slow_chi2_polynomials, trig_sums
from .prepare import inverse_variance, phase, series_stats
from .sums import covariances, direct_sums, for_all
from .templates import TWO_PI, Template, value_at

#: Observations of one task's chunk of a series, and least and most frequencies of one task's block of its grid.
OBSERVATIONS, FREQUENCIES, MOST_FREQUENCIES = 1 << 17, 1 << 11, 1 << 16
#: Most observations of a series that one task takes from sums to fits, so that its sums are not shuffled.
WHOLE = 1 << 15
#: Frequencies that are solved at once, and bytes of an Arrow batch.
TOGETHER, BATCH_BYTES = 1 << 12, 4 << 20
LEAST = 1e-12
FIT = "ordinal int, k long, freq double, power double, a double, b double, c double, sgn double, theta double"


class Block(NamedTuple):
    """A block of a series' frequencies: at is the series' place in its batch, start the first k; even is (step, first, count) on an even grid."""

    at: int
    start: int
    freqs: np.ndarray
    even: tuple[float, int, int] | None
    wsum: float
    ybar: float
    yy: float


#: A block with its sums, or with what was made of them.
Held = list[tuple[Block, np.ndarray]]


def by_block(obs: DataFrame, grid: DataFrame, stats: DataFrame, out: T.StructType, take: Callable, emit: Callable, direct: Callable | None = None, settle: Callable | None = None) -> DataFrame:
    """Rows of out that emit(series, held) yields as batches for some blocks of frequencies and their sums.

    grid is ``grid_shape``'s (series_id, df, nf0, nf), or (k, freq) for all series. take(block, t, w, yc, times) gives
    sums that add up over observations. A series of up to WHOLE observations goes from its observations to rows of out
    in one task, block by block, so its sums are neither held nor shuffled. A longer one is cut into chunks of
    observations, and its grid into blocks, whose partial sums meet by block; so neither a series with a third of all
    rows nor a long grid meets in one task. Equal observations count as one of their joint weight, those without weight
    not at all. direct stands in for take where the series is whole; settle makes the same of a cut one's sums.
    """
    spark = obs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    even = "df" in grid.columns
    shape = stats.select("series_id", "n", "wsum", "ybar", "yy")
    shape = shape.join(grid.select("series_id", "df", "nf0", "nf"), "series_id") if even else shape
    rows = obs.where("dy <> 0").groupBy("series_id", "t", "y", "dy").agg(F.count("*").alias("times")).join(shape, "series_id")
    whole = F.col("n") <= min(WHOLE, OBSERVATIONS)
    salt = F.when(whole, 0).otherwise(F.pmod(F.xxhash64("t", "y", "dy"), F.ceil(F.col("n") / OBSERVATIONS)))
    rows = rows.select(*shape.columns, salt.alias("salt"), "t", (inverse_variance() / F.col("wsum") * F.col("times")).alias("w"), (F.col("y") - F.col("ybar")).alias("yc"), F.col("times").cast("double").alias("times"))
    # A number of partitions: what a task makes of its rows is far more than the rows.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    data = ("t", "w", "yc", "times")
    rows = rows.repartition(parts, "series_id", "salt").groupBy(*shape.columns, "salt").agg(*(F.collect_list(c).alias(c) for c in data))
    if even:
        rows = rows.withColumn("size", F.least(F.lit(MOST_FREQUENCIES), F.greatest(F.lit(FREQUENCIES), "n")).cast("long"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(nf - 1) DIV size")))).withColumn("freqs", F.lit(None).cast("array<double>"))
    else:
        own = grid.withColumn("block", F.expr(f"k DIV {FREQUENCIES}")).groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "freq"))), lambda x: x["freq"]).alias("freqs"))
        zero = F.lit(0).cast("long")
        rows = rows.crossJoin(for_all(own.select("block", F.lit(0.0).alias("df"), zero.alias("nf0"), zero.alias("nf"), F.lit(FREQUENCIES).cast("long").alias("size"), "freqs")))
    keys = ("series_id", "block", "size", "df", "nf0", "nf", "freqs", "wsum", "ybar", "yy")

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[Block, list[pa.Scalar]]]:
        for at, (block, size, df, nf0, nf, freqs, wsum, ybar, yy, *more) in enumerate(zip(*batch.columns[1:])):
            start, width = block.as_py() * size.as_py(), size.as_py()
            if freqs.is_valid:
                f, grid = freqs.values.to_numpy(), None
            else:
                grid = (df.as_py(), nf0.as_py() + start, min(width, nf.as_py() - start))
                f = grid[0] * (grid[1] + np.arange(grid[2]))
            yield Block(at, start, f, grid, wsum.as_py(), ybar.as_py(), yy.as_py() or 0.0), more

    def emitted(batches: Iterator[pa.RecordBatch], made: Callable) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for block, more in blocks(batch):
                found = made(block, more)
                for a in range(0, len(block.freqs), TOGETHER):
                    b = min(a + TOGETHER, len(block.freqs))
                    held.append((block._replace(start=block.start + a, freqs=block.freqs[a:b]), found[a:b]))
                    n += b - a
                    if n >= TOGETHER:
                        yield from emit(batch.column(0), held)
                        held, n = [], 0
            if held:
                yield from emit(batch.column(0), held)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emitted(batches, lambda block, more: (direct or take)(block, *(x.values.to_numpy() for x in more)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, more in blocks(batch):
                sums = take(block, *(x.values.to_numpy() for x in more)).tobytes()
                yield pa.RecordBatch.from_arrays([*(c.slice(block.at, 1) for c in batch.columns[: len(keys)]), pa.array([sums], pa.binary())], [*keys, "sums"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(block: Block, more: list[pa.Scalar]) -> np.ndarray:
            total = sum(np.frombuffer(x.as_buffer()) for x in more[0].values).reshape(len(block.freqs), -1)
            return settle(block, total) if settle else total

        return emitted(batches, made)

    short = rows.where(whole).select(*keys, *data).mapInArrow(at_once, out)
    cut = rows.where(~whole).select(*keys, *data)
    sums = cut.mapInArrow(partial, T.StructType([*(cut.schema[c] for c in keys), T.StructField("sums", T.BinaryType())]))
    sums = sums.groupBy("series_id", "block").agg(*(F.first(c).alias(c) for c in keys[2:]), F.collect_list("sums").alias("sums"))
    return short.union(sums.select(*keys, "sums").mapInArrow(met, out))


def block_sums(block: Block, t: np.ndarray, w: np.ndarray, yc: np.ndarray, harmonics: int, fast: bool = True, always: bool = False) -> np.ndarray:
    """``trig_sums`` of a block. On even grids the sums of a long series are taken by fast transforms, unless fast is false; always takes those of short ones so too."""
    if block.even and (always or fast and len(t) * len(block.freqs) >= FAST_FROM):
        return grid_sums(t, w, yc, *block.even, harmonics)
    return trig_sums(t, w, yc, block.freqs, harmonics)


def spread(held: Held) -> tuple[np.ndarray, ...]:
    """(at, k, freq, sums, wsum, ybar, yy) of all frequencies of some blocks."""
    sizes = [len(b.freqs) for b, _ in held]
    each = lambda x: np.repeat(np.array(x), sizes)
    k = np.concatenate([b.start + np.arange(n) for (b, _), n in zip(held, sizes)])
    return each([b.at for b, _ in held]), k, np.concatenate([b.freqs for b, _ in held]), np.concatenate([x for _, x in held]), *(each([getattr(b, c) for b, _ in held]) for c in ("wsum", "ybar", "yy"))


def exact_power(obs: DataFrame, grid: DataFrame, templates: list[Template], allow_negative: bool = True, stats: DataFrame | None = None, fast: bool = True, keep: str | None = None) -> DataFrame:
    """(series_id, ordinal, k, freq, power, a, b, c, sgn, theta): the best phase of each template at each frequency.

    All templates share one set of sums. power is null where no fit is defined. With keep, the tasks that make the rows
    drop those that don't count: "best" gives the rows of ``best``, "power" those of ``best_template``.
    """
    stats = series_stats(obs) if stats is None else stats
    h = max(len(t.c) for t in templates)
    fields = T._parse_datatype_string("k long, freq double, power double" if keep == "power" else FIT).fields
    out = T.StructType([obs.schema["series_id"], *fields])

    def take(block: Block, t: np.ndarray, w: np.ndarray, yc: np.ndarray, times: np.ndarray) -> np.ndarray:
        return block_sums(block, t, w, yc, h, fast)

    def emit(series: pa.Array, held: Held) -> Iterator[pa.RecordBatch]:
        at, k, f, total, _, ybar, yy = spread(held)
        power = np.full(len(f), np.nan)
        for ordinal, t in enumerate(templates):
            n = len(t.c)
            cut = np.concatenate([np.arange(2 * n), 2 * h + np.arange(2 * n), 4 * h + np.arange(n), 5 * h + np.arange(n)])
            got = best_phase(total[:, cut], t.c, t.s, ybar, yy, allow_negative)
            if keep == "power":
                power = np.fmax(power, got[:, 0])
                continue
            rows = np.arange(len(f))
            if keep == "best":
                rows = np.lexsort((f, -got[:, 0], at))
                rows = rows[np.flatnonzero(np.diff(at[rows], prepend=-1))]
            columns = [pa.array(got[rows, x], pa.float64(), from_pandas=True) for x in range(6)]
            yield pa.RecordBatch.from_arrays([series.take(pa.array(at[rows])), pa.array(np.full(len(rows), ordinal, np.int32)), pa.array(k[rows]), pa.array(f[rows]), *columns], out.names)
        if keep == "power":
            yield pa.RecordBatch.from_arrays([series.take(pa.array(at)), pa.array(k), pa.array(f), pa.array(power, pa.float64(), from_pandas=True)], out.names)

    found = by_block(obs, grid, stats, out, take, emit)
    return best(found) if keep == "best" else found


def best(fits: DataFrame) -> DataFrame:
    """The first best row of each series: by power, then template, then frequency."""
    w = Window.partitionBy("series_id").orderBy(F.desc_nulls_last("power"), "ordinal", "freq")
    return fits.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def best_template(fits: DataFrame) -> DataFrame:
    """(series_id, k, freq, power): the highest power of any template at each frequency."""
    return fits.groupBy("series_id", "k", "freq").agg(F.max("power").alias("power"))


def floating_mean_power(weighted_obs: DataFrame, grid: DataFrame, stats: DataFrame) -> DataFrame:
    """(series_id, freq, power) of one sinusoid with a free mean, in closed form."""
    e = covariances(1)
    sums = direct_sums(weighted_obs, grid, 1).join(stats.select("series_id", "yy"), "series_id")
    sums = sums.select("series_id", "freq", "yy", "yc1", "ys1", *(F.expr(e[k]).alias(k[:2]) for k in ("cc11", "cs11", "ss11")))
    d = F.col("cc") * F.col("ss") - F.col("cs") ** 2
    top = F.col("ss") * F.col("yc1") ** 2 + F.col("cc") * F.col("ys1") ** 2 - F.lit(2.0) * F.col("cs") * F.col("yc1") * F.col("ys1")
    return sums.select("series_id", "freq", F.when((d > LEAST) & (F.col("yy") > 0), top / (F.col("yy") * d)).alias("power"))


def phase_grid_power(weighted_obs: DataFrame, grid: DataFrame, stats: DataFrame, template: Template, phases: int = 50) -> DataFrame:
    """(series_id, freq, power): the highest share over an even grid of phases; a lower bound of ``exact_power``."""
    h = len(template.c)
    sums = direct_sums(weighted_obs, grid, h).join(stats.select("series_id", "yy"), "series_id")
    sums = sums.select("*", *(F.expr(e).alias(n) for n, e in covariances(h).items()))
    spark = sums.sparkSession
    shifts = []
    for p in range(phases):
        theta = TWO_PI * p / phases
        row = [p]
        for n, (c, s) in enumerate(zip(template.c, template.s), 1):
            row += [c * math.cos(n * theta) - s * math.sin(n * theta), c * math.sin(n * theta) + s * math.cos(n * theta)]
        shifts.append(row)
    table = spark.createDataFrame(shifts, ", ".join(["p int", *(f"a{n} double, b{n} double" for n in range(1, h + 1))]))
    ym = " + ".join(f"a{n} * yc{n} + b{n} * ys{n}" for n in range(1, h + 1))
    mm = " + ".join(f"a{j} * a{k} * cc{j}{k} + 2 * a{j} * b{k} * cs{j}{k} + b{j} * b{k} * ss{j}{k}" for j in range(1, h + 1) for k in range(1, h + 1))
    rows = sums.crossJoin(F.broadcast(table)).select("series_id", "freq", "yy", F.expr(ym).alias("ym"), F.expr(mm).alias("mm"))
    share = F.when((F.col("mm") > LEAST) & (F.col("yy") > 0), F.col("ym") ** 2 / (F.col("mm") * F.col("yy")))
    return rows.groupBy("series_id", "freq").agg(F.max(share).alias("power"))


def amplitude_offset(obs: DataFrame, freq: str | Column, shift: float, template: Template) -> DataFrame:
    """(series_id, amplitude, offset, chi2): the weighted linear fit of the template delayed by shift (in phase)."""
    w = inverse_variance()
    m = obs.select("*", value_at(phase("t", freq) - F.lit(float(shift)), template).alias("m"), w.alias("om"))
    means = m.groupBy("series_id").agg(*((F.sum(F.col("om") * F.col(x)) / F.sum("om")).alias(f"{x}0") for x in ("m", "y")))
    centred = m.join(means, "series_id")
    dm, dy = F.col("m") - F.col("m0"), F.col("y") - F.col("y0")
    got = centred.groupBy("series_id", "m0", "y0").agg(F.sum(F.col("om") * dm * dm).alias("mm"), F.sum(F.col("om") * dm * dy).alias("my"), F.sum(F.col("om") * dy * dy).alias("yy"))
    a = F.col("my") / F.when(F.col("mm") > LEAST, F.col("mm"))
    return got.select("series_id", a.alias("amplitude"), (F.col("y0") - a * F.col("m0")).alias("offset"), (F.col("yy") - a * F.col("my")).alias("chi2"))


def predict(obs: DataFrame, params: DataFrame, template: Template) -> DataFrame:
    """obs with yfit, by params (series_id, freq, a, b, c, sgn): the delay is decoded from b and sgn."""
    wtau = F.when(F.col("sgn") < 0, F.lit(TWO_PI) - F.acos("b")).otherwise(F.acos("b"))
    p = params.select("series_id", "freq", F.col("a").alias("amp"), F.col("c").alias("off"), (wtau / F.lit(TWO_PI)).alias("shift"))
    joined = obs.join(p, "series_id")
    x = F.col("t") * F.col("freq") - F.col("shift")
    return joined.select(*obs.columns, (F.col("amp") * value_at(x - F.floor(x), template) + F.col("off")).alias("yfit"))


def power_from_fit(fitted: DataFrame, stats: DataFrame) -> DataFrame:
    """(series_id, power): the share of weighted variance that yfit explains."""
    left = fitted.groupBy("series_id").agg(F.sum(inverse_variance() * (F.col("y") - F.col("yfit")) ** 2).alias("chi2"))
    return left.join(stats, "series_id").select("series_id", F.when(F.col("chi2_ref") > 0, F.lit(1.0) - F.col("chi2") / F.col("chi2_ref")).alias("power"))


def _slow(obs: DataFrame, grid: DataFrame, template: Template, stats: DataFrame, fields: str, emit: Callable, phases: int | None = None) -> DataFrame:
    """emit's rows of weighted and plain sums, side by side with the number of observations and the sum of y less its weighted mean; with phases, of residuals at even phases over the sum of the weights."""
    h = len(template.c)
    out = T.StructType([obs.schema["series_id"], *T._parse_datatype_string(fields).fields])

    def take(block: Block, t: np.ndarray, w: np.ndarray, yc: np.ndarray, times: np.ndarray) -> np.ndarray:
        ones = np.ones((len(block.freqs), 1))
        return np.concatenate([block_sums(block, t, w, yc, h), block_sums(block, t, times, yc, h), ones * times.sum(), ones * (times @ yc)], axis=1)

    if phases is None:
        return by_block(obs, grid, stats, out, take, lambda series, held: emit(out.names, series, held))

    def direct(block: Block, t: np.ndarray, w: np.ndarray, yc: np.ndarray, times: np.ndarray) -> np.ndarray:
        return direct_slow_chi2(t, w, yc, times, block.freqs, template.c, template.s, phases)

    def settle(block: Block, total: np.ndarray) -> np.ndarray:
        w, plain, shift = parted(total, h)
        size = phases * -(-(2 * h + 1) // phases)
        at = slow_chi2_polynomials(w, plain, template.c, template.s, size)
        return slow_chi2([x[:, :: size // phases] for x in at], shift[:, None], np.full((len(total), 1), block.yy))

    return by_block(obs, grid, stats, out, take, lambda series, held: emit(out.names, series, held), direct, settle)


def parted(total: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted sums, plain ones with the plain mean of y taken off, and the weighted mean of y less the plain one."""
    w, plain, n, y = total[:, : 6 * h], total[:, 6 * h : 12 * h].copy(), total[:, -2:-1], total[:, -1:]
    plain /= n
    shift = -y / n
    plain[:, 4 * h : 5 * h] += shift * plain[:, :h]
    plain[:, 5 * h :] += shift * plain[:, 2 * h : 3 * h]
    return w, plain, shift[:, 0]


def unweighted_chi2(obs: DataFrame, grid: DataFrame, template: Template, phases: int = 20) -> DataFrame:
    """(series_id, freq, p, chi2): weighted residuals of an unweighted linear fit at each phase p / phases.

    Amplitude and offset come from ordinary least squares, but residuals are weighted: not the weighted optimum for
    unequal errors, so its power is at most that of ``exact_power``.
    """

    def emit(names: list[str], series: pa.Array, held: Held) -> Iterator[pa.RecordBatch]:
        at, _, f, chi2, wsum, _, _ = spread(held)
        p = np.tile(np.arange(phases, dtype=np.int32), len(f))
        yield pa.RecordBatch.from_arrays([series.take(pa.array(np.repeat(at, phases))), pa.array(np.repeat(f, phases)), pa.array(p), pa.array((chi2 * wsum[:, None]).ravel(), pa.float64(), from_pandas=True)], names)

    return _slow(obs, grid, template, series_stats(obs), "freq double, p int, chi2 double", emit, phases)


def slow_power(obs: DataFrame, grid: DataFrame, template: Template, stats: DataFrame, phases: int = 20) -> DataFrame:
    """(series_id, freq, power) by the least of ``unweighted_chi2`` over the phases."""

    def emit(names: list[str], series: pa.Array, held: Held) -> Iterator[pa.RecordBatch]:
        at, _, f, chi2, _, _, yy = spread(held)
        power = 1 - np.fmin.reduce(chi2, axis=1) / np.where(yy > 0, yy, np.nan)
        yield pa.RecordBatch.from_arrays([series.take(pa.array(at)), pa.array(f), pa.array(power, pa.float64(), from_pandas=True)], names)

    return _slow(obs, grid, template, stats, "freq double, power double", emit, phases)


def refined_slow_power(obs: DataFrame, grid: DataFrame, template: Template, stats: DataFrame, phases: int = 20) -> DataFrame:
    """(series_id, k, freq, power): ``slow_power`` at the best phase, by bracketed refinement of the three best of the phases.

    The residuals at any phase follow from two sets of sums, weighted and not, so the observations are read once. power
    is null where no fit is defined; a bracket always closes, so no frequency fails to converge.
    """
    h = len(template.c)

    def emit(names: list[str], series: pa.Array, held: Held) -> Iterator[pa.RecordBatch]:
        at, k, f, total, _, _, yy = spread(held)
        w, plain, shift = parted(total, h)
        power = 1 - least_slow_chi2(w, plain, template.c, template.s, shift, yy, phases)
        yield pa.RecordBatch.from_arrays([series.take(pa.array(at)), pa.array(k), pa.array(f), pa.array(power, pa.float64(), from_pandas=True)], names)

    return _slow(obs, grid, template, stats, "k long, freq double, power double", emit)
