"""The registered queries of the period-search engine, and the same in DuckDB's SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import fit, grid, prepare, sums, templates
from .operators.templates import Template
from .plans import MultiTemplateSearch, TemplateSearch
from .sources.observations import days, event_observations, observations

#: The test templates, as (c, s) by harmonic.
FIRST = Template((-0.181, -0.1, -0.020), (-0.110, 0.0, 0.030), "first")
SECOND = Template((0.2, 0.0, 0.2), (0.2, 0.2, 0.0), "second")
STEP, STEPS, PHASES, ONE = 0.05, 40, 50, 0.75
DIGITS = 1e6
#: Digits of a share at a phase that was sought.
FITTED = 1e5


def rounded(c: str | Column, digits: float = DIGITS) -> Column:
    """To six digits after the point, or so many as digits says, in a way that both engines share."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * digits + 0.5).cast("double") / digits


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(rounded(c).alias(c) if c in names else F.col(c) for c in df.columns))


def _data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    obs = event_observations(spark, sf_dir)
    stats = prepare.series_stats(obs)
    return obs, stats, prepare.weighted(obs, stats)


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(1, STEPS + 1).select((F.col("id") - 1).alias("k"), (F.col("id") * STEP).alias("freq"))


def p1_observations(spark, sf_dir):
    return _round(event_observations(spark, sf_dir), "t")


def p2_weights(spark, sf_dir):
    return _round(_data(spark, sf_dir)[2].select("series_id", "t", "w", "yc"), "t", "w", "yc")


def p3_weighted_stats(spark, sf_dir):
    stats = _data(spark, sf_dir)[1]
    return _round(stats.select("series_id", "n", "tmin", "tmax", "ybar", rounded("yy", 1e3).alias("yy"), rounded("chi2_ref", 1e3).alias("chi2_ref")), "tmin", "tmax", "ybar")


def p5_order_violations(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return prepare.order_violations(events.select(F.col("user_id").alias("series_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")), "event_id")


def p9_grid_check(spark, sf_dir):
    return _round(grid.inspect_grid(grid.autofrequency(_data(spark, sf_dir)[1])), "df")


def p11_phase_fold(spark, sf_dir):
    obs = event_observations(spark, sf_dir)
    return _round(obs.select("series_id", "t", prepare.phase(F.col("t") - 10.0, F.lit(0.3)).alias("phase")), "t", "phase")


def f1_autofrequency(spark, sf_dir):
    return _round(grid.autofrequency(_data(spark, sf_dir)[1]), "freq")


def f1_autofrequency_minmax_compat(spark, sf_dir):
    return _round(grid.autofrequency(_data(spark, sf_dir)[1], minimum_frequency=0.2, maximum_frequency=1.5), "freq")


def s1_direct_sums(spark, sf_dir):
    got = sums.direct_sums(_data(spark, sf_dir)[2], _grid(spark), 1)
    return _round(got, *got.columns[1:])


def s4_covariance_matrices(spark, sf_dir):
    got = sums.with_covariances(sums.direct_sums(_data(spark, sf_dir)[2], _grid(spark), 2), 2).select("series_id", "freq", *sums.covariances(2))
    return _round(got, *got.columns[1:])


def m3_floating_mean_power(spark, sf_dir):
    _, stats, w = _data(spark, sf_dir)
    return _round(fit.floating_mean_power(w, _grid(spark), stats), "freq", "power")


def m4_phase_grid_power_h3(spark, sf_dir):
    _, stats, w = _data(spark, sf_dir)
    return _round(fit.phase_grid_power(w, _grid(spark), stats, FIRST, PHASES), "freq", "power")


def m8_amplitude_offset(spark, sf_dir):
    return _round(fit.amplitude_offset(event_observations(spark, sf_dir), F.lit(ONE), 0.2, FIRST).select("series_id", "amplitude", "offset"), "amplitude", "offset")


def m9_chi2(spark, sf_dir):
    return fit.amplitude_offset(event_observations(spark, sf_dir), F.lit(ONE), 0.2, FIRST).select("series_id", rounded("chi2", 1e3).alias("chi2"))


def _params(spark, sf_dir) -> DataFrame:
    got = _data(spark, sf_dir)[1]
    return got.select("series_id", F.lit(ONE).alias("freq"), (F.lit(50.0) + F.col("series_id") % 7).alias("a"), F.lit(0.3).alias("b"), F.col("ybar").alias("c"), F.when(F.col("series_id") % 2 == 0, 1.0).otherwise(-1.0).alias("sgn"))


def e2_model_eval(spark, sf_dir):
    got = fit.predict(event_observations(spark, sf_dir), _params(spark, sf_dir), FIRST)
    return _round(got.select("series_id", "t", "yfit"), "t", "yfit")


def m7_power_from_fit(spark, sf_dir):
    obs, stats, _ = _data(spark, sf_dir)
    return _round(fit.power_from_fit(fit.predict(obs, _params(spark, sf_dir), FIRST), stats), "power")


def _samples(spark, sf_dir) -> DataFrame:
    """A shape a series: its values in order of their number, as samples."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return events.select(F.col("user_id").alias("template_id"), idx.alias("idx"), F.col("value").alias("val"))


def t1_normalise(spark, sf_dir):
    got = templates.normalised(_samples(spark, sf_dir).select("template_id", (F.col("idx") + 1).alias("n"), F.col("val").alias("c"), (F.col("val") / 2).alias("s")))
    return _round(got.select("template_id", F.col("n").cast("long").alias("n"), "c", "s"), "c", "s")


def t2_from_sampled(spark, sf_dir):
    return _round(templates.from_sampled(_samples(spark, sf_dir), 5).withColumn("n", F.col("n").cast("long")), "c", "s")


def t3_auto_harmonics(spark, sf_dir):
    return templates.from_sampled(_samples(spark, sf_dir), 0.9).groupBy("template_id").agg(F.max("n").cast("long").alias("h"))


def t4_eval(spark, sf_dir):
    obs = event_observations(spark, sf_dir)
    return _round(obs.select("series_id", "t", templates.value_at(prepare.phase("t", F.lit(ONE)), FIRST).alias("value")), "t", "value")


def g3_shifted_template(spark, sf_dir):
    obs = event_observations(spark, sf_dir)
    return _round(obs.select("series_id", "t", templates.value_at(prepare.phase("t", F.lit(ONE)) - 0.2, FIRST).alias("value")), "t", "value")


def w1_best_frequency(spark, sf_dir):
    _, stats, w = _data(spark, sf_dir)
    got = fit.floating_mean_power(w, _grid(spark), stats).withColumn("power", rounded("power")).withColumn("ordinal", F.lit(0))
    return _round(fit.best(got).select("series_id", "freq", "power"), "freq")


def x5_multi_template_max(spark, sf_dir):
    _, stats, w = _data(spark, sf_dir)
    both = [fit.phase_grid_power(w, _grid(spark), stats, t, PHASES) for t in (FIRST, SECOND)]
    return _round(both[0].union(both[1]).groupBy("series_id", "freq").agg(F.max("power").alias("power")), "freq", "power")


def l2_slow_chi2_grid(spark, sf_dir):
    got = fit.unweighted_chi2(event_observations(spark, sf_dir), _grid(spark), FIRST, 10)
    return _round(got.select("series_id", "freq", F.col("p").cast("long").alias("p"), rounded("chi2", 1e3).alias("chi2")), "freq")


def l4_slow_power(spark, sf_dir):
    obs, stats, _ = _data(spark, sf_dir)
    return _round(fit.slow_power(obs, _grid(spark), FIRST, stats, 10), "freq", "power")


def l3_refined_slow_power(spark, sf_dir):
    obs, stats, _ = _data(spark, sf_dir)
    got = fit.refined_slow_power(obs, _grid(spark), FIRST, stats)
    return got.select("series_id", "k", rounded("freq").alias("freq"), rounded("power", 1e4).alias("power"))


def m2_exact_power_h3(spark, sf_dir):
    obs, stats, _ = _data(spark, sf_dir)
    got = fit.exact_power(obs, _grid(spark), [FIRST], stats=stats, keep="power")
    return got.select("series_id", "k", rounded("freq").alias("freq"), rounded("power", FITTED).alias("power"))


def e6_autopower(spark, sf_dir):
    obs, stats, _ = _data(spark, sf_dir)
    got = fit.exact_power(obs, grid.grid_shape(stats), [FIRST], stats=stats, keep="power")
    return got.select("series_id", "k", rounded("freq").alias("freq"), rounded("power", FITTED).alias("power"))


def _model(found: DataFrame) -> DataFrame:
    """Models to the digits that two ways of finding the phase share."""
    return found.select("series_id", F.col("ordinal").cast("long").alias("ordinal"), rounded("freq").alias("freq"), rounded("power", FITTED).alias("power"), *(rounded(x, 1e3).alias(x) for x in ("a", "b", "c", "theta")))


def e8_best_models(spark, sf_dir):
    obs, stats, _ = _data(spark, sf_dir)
    return _model(fit.exact_power(obs, grid.grid_shape(stats), [FIRST], stats=stats, keep="best"))


def x2_fit_model(spark, sf_dir):
    search = MultiTemplateSearch([FIRST, SECOND]).fit(event_observations(spark, sf_dir))
    return _model(search.fit_model(ONE))


def e5_fit_model(spark, sf_dir):
    return _model(TemplateSearch(FIRST).fit(event_observations(spark, sf_dir)).fit_model(ONE).params)


def e7_power(spark, sf_dir):
    """Power at frequencies in an array of two dimensions."""
    got = TemplateSearch(FIRST).fit(event_observations(spark, sf_dir)).power([[0.5, 0.7, 0.9], [1.1, 1.3, 1.5]], save_best_model=False)
    return got.select("series_id", "k", rounded("freq").alias("freq"), rounded("power", FITTED).alias("power"))


def x4_single_template(spark, sf_dir):
    """Power of a template that is not among the search's own, on an even grid by fast sums."""
    search = MultiTemplateSearch([FIRST]).fit(event_observations(spark, sf_dir))
    got = search.power_from_single_template([STEP * k for k in range(1, STEPS + 1)], SECOND, fast=True, save_best_model=False)
    return got.select("series_id", "k", rounded("freq").alias("freq"), rounded("power", FITTED).alias("power"))


def g2_mixed_template(spark, sf_dir):
    """The coefficients of a mixture of two templates."""
    got = templates.template_table(spark, [templates.mixed(FIRST, SECOND, 0.3, 3)])
    return _round(got.select(F.col("n").cast("long").alias("n"), "c", "s"), "c", "s")


def x3_multi_autopower(spark, sf_dir):
    obs, stats, _ = _data(spark, sf_dir)
    got = fit.exact_power(obs, grid.grid_shape(stats), [FIRST, SECOND], stats=stats, keep="power")
    return got.select("series_id", "k", rounded("freq").alias("freq"), rounded("power", FITTED).alias("power"))


def e8_save_best_model(spark, sf_dir):
    """Of two given models a series, the one that is kept: the later one only where it explains strictly more."""
    search = MultiTemplateSearch([FIRST]).fit(event_observations(spark, sf_dir))
    search.known = [FIRST]
    old = _params(spark, sf_dir).withColumn("ordinal", F.lit(0))
    search.save_best_model(old)
    search.save_best_model(old.withColumn("a", F.lit(40.0) + F.col("series_id") % 5).withColumn("b", F.lit(-0.2)))
    kept = search.best_model.select("series_id", "a", "b")
    search.close()
    return kept


def s4_fast_sums(spark, sf_dir):
    """The sums of s1 by fast transforms."""
    obs, stats, _ = _data(spark, sf_dir)
    even = stats.select("series_id", F.lit(STEP).alias("df"), F.lit(1).cast("long").alias("nf0"), F.lit(STEPS).cast("long").alias("nf"))
    got = sums.fast_sums(obs, even, 1, stats)
    return _round(got, *got.columns[1:])


def p9_uneven_grid(spark, sf_dir):
    """The check of a grid whose steps grow."""
    ids = event_observations(spark, sf_dir).select("series_id").distinct()
    uneven = ids.crossJoin(spark.range(8).select(F.col("id").alias("k"))).withColumn("freq", F.lit(0.5) + 0.1 * F.col("k") + 0.01 * F.col("k") * F.col("k"))
    return _round(grid.inspect_grid(uneven), "df")


def p10_missing_errors(spark, sf_dir):
    """Moments where every third error is missing."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    err = F.when(F.col("event_id") % 3 > 0, F.lit(1.0) + F.lit(0.25) * (F.col("event_id") % 5))
    stats = prepare.series_stats(observations(events, "user_id", days("ts"), "value", err))
    return _round(stats.select("series_id", "n", "wsum", "ybar", rounded("yy", 1e3).alias("yy")), "wsum", "ybar")


def t6_reversed_samples(spark, sf_dir):
    """Templates of shapes read backwards."""
    backwards = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    samples = events.select(F.col("user_id").alias("template_id"), (F.row_number().over(backwards) - 1).alias("idx"), F.col("value").alias("val"))
    return _round(templates.from_sampled(samples, 5).withColumn("n", F.col("n").cast("long")), "c", "s")


def _injected(spark, sf_dir, noise: float) -> DataFrame:
    obs = event_observations(spark, sf_dir)
    signal = 3.0 + 2.0 * templates.value_at(prepare.phase("t", F.lit(ONE)) - 0.2, FIRST)
    return obs.withColumn("y", signal + noise * F.sin(F.col("t") * 1000.0))


def g1_inject_signal(spark, sf_dir):
    return _round(_injected(spark, sf_dir, 0.1).select("series_id", "t", "y"), "t", "y")


def g4_inject_and_recover(spark, sf_dir):
    """The model of a signal without noise, at its own frequency."""
    return _model(TemplateSearch(FIRST).fit(_injected(spark, sf_dir, 0.0)).fit_model(ONE).params)


def g5_folded_overlay(spark, sf_dir):
    """Phases of the observations, with the model's curve beside them."""
    got = fit.predict(event_observations(spark, sf_dir), _params(spark, sf_dir), FIRST)
    return _round(got.select("series_id", prepare.phase("t", F.lit(ONE)).alias("phase"), "y", "yfit"), "phase", "yfit")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e8_best_models(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        p1_observations, p2_weights, p3_weighted_stats, p5_order_violations, p9_grid_check, p11_phase_fold, f1_autofrequency, f1_autofrequency_minmax_compat, s1_direct_sums, s4_covariance_matrices,
        m2_exact_power_h3, m3_floating_mean_power, m4_phase_grid_power_h3, m7_power_from_fit, m8_amplitude_offset, m9_chi2, e2_model_eval, e6_autopower, e8_best_models,
        t1_normalise, t2_from_sampled, t3_auto_harmonics, t4_eval, t6_reversed_samples, g1_inject_signal, g3_shifted_template, g4_inject_and_recover, g5_folded_overlay, w1_best_frequency, x2_fit_model, x3_multi_autopower, x5_multi_template_max,
        l2_slow_chi2_grid, l3_refined_slow_power, l4_slow_power, p9_uneven_grid, p10_missing_errors, s4_fast_sums, e8_save_best_model, e5_fit_model, e7_power, x4_single_template, g2_mixed_template,
    )
    return {f.__name__: f for f in found}


# ---------------------------------------------------------------- DuckDB

_D = "CAST({} AS DOUBLE)".format


def _r(e: str, digits: str = "1e6") -> str:
    return f"floor(({e}) * {_D(digits)} + {_D('0.5')}) / {_D(digits)}"


def _value(phase: str, t: Template) -> str:
    return " + ".join(f"{_D(repr(c))} * cos({_D(repr(2 * math.pi * n))} * ({phase})) + {_D(repr(s))} * sin({_D(repr(2 * math.pi * n))} * ({phase}))" for n, (c, s) in enumerate(zip(t.c, t.s), 1))


_OBS = f"""obs AS (SELECT user_id AS series_id, CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS DOUBLE) / {_D('86400000000')} AS t,
  value AS y, {_D(1)} + {_D('0.25')} * CAST(event_id % 5 AS DOUBLE) AS dy FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
m AS (SELECT series_id, count(*) AS n, min(t) AS tmin, max(t) AS tmax, sum(1 / (dy * dy)) AS wsum, sum(y / (dy * dy)) / sum(1 / (dy * dy)) AS ybar FROM obs GROUP BY series_id),
st AS (SELECT m.*, q.chi2_ref, q.chi2_ref / m.wsum AS yy FROM m JOIN (SELECT obs.series_id, sum((y - ybar) * (y - ybar) / (dy * dy)) AS chi2_ref FROM obs JOIN m ON obs.series_id = m.series_id GROUP BY obs.series_id) q ON m.series_id = q.series_id),
wt AS (SELECT obs.*, 1 / (dy * dy) / wsum AS w, y - ybar AS yc FROM obs JOIN m ON obs.series_id = m.series_id),
gr AS (SELECT k - 1 AS k, CAST(k AS DOUBLE) * {_D(STEP)} AS freq FROM range(1, {STEPS + 1}) g(k))"""


def _sums(h: int) -> str:
    x = f"{_D(repr(2 * math.pi))} * freq * t"
    parts = [f"sum(w * {f}({x} * {j})) AS {n}{j}" for j in range(1, 2 * h + 1) for f, n in (("cos", "c"), ("sin", "s"))]
    parts += [f"sum(w * yc * {f}({x} * {j})) AS {n}{j}" for j in range(1, h + 1) for f, n in (("cos", "yc"), ("sin", "ys"))]
    return f"su AS (SELECT series_id, freq, {', '.join(parts)} FROM wt CROSS JOIN gr GROUP BY series_id, freq)"


def _cov(h: int) -> str:
    """Covariances from the definition: mean products less products of means."""
    x = f"{_D(repr(2 * math.pi))} * freq * t"
    out = []
    for j in range(1, h + 1):
        for k in range(1, h + 1):
            for n, f, g in (("cc", "cos", "cos"), ("cs", "cos", "sin"), ("ss", "sin", "sin")):
                out.append(f"sum(w * {f}({j} * {x}) * {g}({k} * {x})) - sum(w * {f}({j} * {x})) * sum(w * {g}({k} * {x})) AS {n}{j}{k}")
    y = [f"sum(w * yc * {f}({x} * {j})) AS {n}{j}" for j in range(1, h + 1) for f, n in (("cos", "yc"), ("sin", "ys"))]
    return f"cv AS (SELECT series_id, freq, {', '.join(out + y)} FROM wt CROSS JOIN gr GROUP BY series_id, freq)"


def _phase_power(t: Template, name: str) -> str:
    """The highest share over the phases, straight from the covariances."""
    h = len(t.c)
    a = {n: f"({_D(repr(c))} * cos({n} * th) - {_D(repr(s))} * sin({n} * th))" for n, (c, s) in enumerate(zip(t.c, t.s), 1)}
    b = {n: f"({_D(repr(c))} * sin({n} * th) + {_D(repr(s))} * cos({n} * th))" for n, (c, s) in enumerate(zip(t.c, t.s), 1)}
    ym = " + ".join(f"{a[n]} * yc{n} + {b[n]} * ys{n}" for n in a)
    mm = " + ".join(f"{a[j]} * {a[k]} * cc{j}{k} + 2 * {a[j]} * {b[k]} * cs{j}{k} + {b[j]} * {b[k]} * ss{j}{k}" for j in range(1, h + 1) for k in range(1, h + 1))
    return f"""{name} AS (SELECT z.series_id, freq, max(CASE WHEN mm > 1e-12 AND yy > 0 THEN ym * ym / (mm * yy) END) AS power FROM
      (SELECT series_id, freq, {ym} AS ym, {mm} AS mm FROM cv CROSS JOIN (SELECT {_D(repr(2 * math.pi))} * CAST(p AS DOUBLE) / {PHASES} AS th FROM range(0, {PHASES}) r(p)) ph) z
      JOIN st ON z.series_id = st.series_id GROUP BY z.series_id, freq)"""


def _closed() -> str:
    return """h1 AS (SELECT cv.series_id, freq, CASE WHEN cc11 * ss11 - cs11 * cs11 > 1e-12 AND yy > 0 THEN
      (ss11 * yc1 * yc1 + cc11 * ys1 * ys1 - 2 * cs11 * yc1 * ys1) / (yy * (cc11 * ss11 - cs11 * cs11)) END AS power FROM cv JOIN st ON cv.series_id = st.series_id)"""


def _definition(h: int, grid: str, name: str) -> str:
    """name(series_id, k, freq, yy, ybar, ...): covariances and means from their definition, at the rows of grid (a relation of series_id, k, freq)."""
    x = f"{_D(repr(2 * math.pi))} * freq * t"
    waves = [f"{f}({x} * {j}) AS {n}{j}" for j in range(1, h + 1) for f, n in (("cos", "c"), ("sin", "s"))]
    out = [f"sum(w * {p}{j} * {q}{k}) - sum(w * {p}{j}) * sum(w * {q}{k}) AS {p}{q}{j}{k}" for j in range(1, h + 1) for k in range(1, h + 1) for p, q in ("cc", "cs", "ss")]
    out += [f"sum(w * yc * {p}{j}) AS y{p}{j}, sum(w * {p}{j}) AS m{p}{j}" for j in range(1, h + 1) for p in "cs"]
    return f"""{name} AS (SELECT q.*, st.yy, st.ybar FROM (SELECT series_id, k, freq, {", ".join(out)} FROM
      (SELECT wt.series_id, g.k, g.freq, w, yc, {", ".join(waves)} FROM wt JOIN {grid} g ON wt.series_id = g.series_id) GROUP BY series_id, k, freq) q JOIN st ON q.series_id = st.series_id)"""


def _best_phase(t: Template, cov: str, name: str, points: int = 96) -> str:
    """name(series_id, k, freq, power, a, b, c, theta): the best phase of a template, by a scan and parabolas through its three highest peaks."""
    h = len(t.c)
    turned = ", ".join(f"{_D(repr(c))} * cos({n} * th) - {_D(repr(s))} * sin({n} * th) AS a{n}, {_D(repr(c))} * sin({n} * th) + {_D(repr(s))} * cos({n} * th) AS b{n}" for n, (c, s) in enumerate(zip(t.c, t.s), 1))
    ym = " + ".join(f"a{n} * yc{n} + b{n} * ys{n}" for n in range(1, h + 1))
    mean = " + ".join(f"a{n} * mc{n} + b{n} * ms{n}" for n in range(1, h + 1))
    mm = " + ".join(f"a{j} * a{k} * cc{j}{k} + 2 * a{j} * b{k} * cs{j}{k} + b{j} * b{k} * ss{j}{k}" for j in range(1, h + 1) for k in range(1, h + 1))
    at = lambda rows: f"""(SELECT *, CASE WHEN mm > 1e-12 AND yy > 0 THEN ym * ym / (mm * yy) END AS p FROM (SELECT *, {ym} AS ym, {mm} AS mm, {mean} AS mean FROM (SELECT *, {turned} FROM {rows})))"""
    step = repr(2 * math.pi / points)
    parts = [
        f"{name}_s AS (SELECT series_id, k, list(p ORDER BY i) AS l FROM {at(f'(SELECT {cov}.*, i, i * {_D(step)} AS th FROM {cov} CROSS JOIN range(0, {points}) r(i))')} GROUP BY series_id, k)",
        f"{name}_p AS (SELECT series_id, k, l, unnest(range(1, {points + 1})) AS i FROM {name}_s)",
        f"""{name}_0 AS (SELECT series_id, k, i, (i - 1) * {_D(step)} AS th FROM {name}_p WHERE l[i] >= l[CASE WHEN i = 1 THEN {points} ELSE i - 1 END] AND l[i] >= l[i % {points} + 1]
          QUALIFY row_number() OVER (PARTITION BY series_id, k ORDER BY l[i] DESC, i) <= 3)""",
    ]
    for n in range(4):
        d = _D(repr(2 * math.pi / points / 4**n))
        parts.append(f"""{name}_{n + 1} AS (SELECT series_id, k, i, any_value(th0) + {d} * coalesce(greatest(-1, least(1, (max(p) FILTER (e = -1) - max(p) FILTER (e = 1)) / 2 /
          nullif(max(p) FILTER (e = -1) - 2 * max(p) FILTER (e = 0) + max(p) FILTER (e = 1), 0))), 0) AS th
          FROM {at(f"(SELECT {cov}.*, z.i, z.th AS th0, e, z.th + e * {d} AS th FROM {name}_{n} z JOIN {cov} ON z.series_id = {cov}.series_id AND z.k = {cov}.k CROSS JOIN (VALUES (-1), (0), (1)) v(e))")} GROUP BY series_id, k, i)""")
    final = f"(SELECT {cov}.*, z.th FROM {cov} LEFT JOIN {name}_4 z ON z.series_id = {cov}.series_id AND z.k = {cov}.k)"
    parts.append(f"""{name} AS (SELECT series_id, k, freq, p AS power, CASE WHEN p IS NOT NULL THEN ym / mm END AS a, CASE WHEN p IS NOT NULL THEN cos(th) END AS b, CASE WHEN p IS NOT NULL THEN ybar - ym / mm * mean END AS c,
      CASE WHEN p IS NOT NULL THEN th - {_D(repr(2 * math.pi))} * floor(th / {_D(repr(2 * math.pi))}) END AS theta FROM {at(final)} QUALIFY row_number() OVER (PARTITION BY series_id, k ORDER BY p DESC NULLS LAST, th) = 1)""")
    return ", ".join(parts)


def _least_slow(t: Template, points: int = 36) -> str:
    """ls(series_id, k, chi2): the least residuals of unweighted fits, by a scan and parabolas through its three lowest valleys, from the observations."""
    at = lambda rows: f"""(SELECT sl.series_id, sl.k, sl.i, sl.e, any_value(th0) AS th0, sum(om * (y - a * m - c) * (y - a * m - c)) AS p FROM
      (SELECT z.*, y, 1 / (dy * dy) AS om, {_value('t * freq - floor(t * freq) - th', t)} AS m FROM {rows} z JOIN obs ON obs.series_id = z.series_id) sl JOIN
      (SELECT series_id, k, i, e, regr_slope(y, m) AS a, regr_intercept(y, m) AS c FROM (SELECT z.*, y, {_value('t * freq - floor(t * freq) - th', t)} AS m FROM {rows} z JOIN obs ON obs.series_id = z.series_id) GROUP BY series_id, k, i, e) co
      ON sl.series_id = co.series_id AND sl.k = co.k AND sl.i = co.i AND sl.e = co.e GROUP BY sl.series_id, sl.k, sl.i, sl.e)"""  # noqa: E731
    parts = [
        f"ls_s AS (SELECT series_id, k, list(p ORDER BY i) AS l FROM {at(f'(SELECT st.series_id, k, freq, i, 0 AS e, 0 AS th0, i / {_D(points)} AS th FROM st CROSS JOIN gr CROSS JOIN range(0, {points}) r(i))')} GROUP BY series_id, k)",
        f"ls_p AS (SELECT series_id, k, l, unnest(range(1, {points + 1})) AS i FROM ls_s)",
        f"""ls_0 AS (SELECT ls_p.series_id, ls_p.k, freq, i, (i - 1) / {_D(points)} AS th FROM ls_p JOIN gr ON ls_p.k = gr.k WHERE l[i] <= l[CASE WHEN i = 1 THEN {points} ELSE i - 1 END] AND l[i] <= l[i % {points} + 1]
          QUALIFY row_number() OVER (PARTITION BY ls_p.series_id, ls_p.k ORDER BY l[i], i) <= 3)""",
    ]
    for n in range(5):
        d = _D(repr(1 / points / 4**n))
        rows = f"(SELECT series_id, k, freq, i, e, th AS th0, th + e * {d} AS th FROM ls_{n} CROSS JOIN (VALUES (-1), (0), (1)) v(e))"
        parts.append(f"""ls_{n + 1} AS (SELECT q.series_id, q.k, gr.freq, i, th FROM (SELECT series_id, k, i, any_value(th0) + {d} * coalesce(greatest(-1, least(1, (max(p) FILTER (e = -1) - max(p) FILTER (e = 1)) / 2 /
          nullif(max(p) FILTER (e = -1) - 2 * max(p) FILTER (e = 0) + max(p) FILTER (e = 1), 0))), 0) AS th FROM {at(rows)} GROUP BY series_id, k, i) q JOIN gr ON q.k = gr.k)""")
    parts.append(f"ls AS (SELECT series_id, k, min(p) AS chi2 FROM {at('(SELECT series_id, k, freq, i, 0 AS e, th AS th0, th FROM ls_5)')} GROUP BY series_id, k)")
    return ", ".join(parts)


def oracle_sql() -> dict[str, str]:
    with_ = lambda *parts: "WITH " + ", ".join((_OBS, *parts)) + " "
    fold = lambda t, f: f"({t}) * {f} - floor(({t}) * {f})"
    auto = f"SELECT series_id, n, 1 / ((tmax - tmin) * {_D(5)}) AS df FROM st WHERE tmax > tmin"
    m = f"SELECT *, 1 / (dy * dy) AS om, {_value(fold('t', _D(ONE)) + ' - ' + _D('0.2'), FIRST)} AS m FROM obs"
    lin = f"""lin AS (SELECT series_id, (sum(om * m * y) / sum(om) - sum(om * m) / sum(om) * sum(om * y) / sum(om)) / (sum(om * m * m) / sum(om) - (sum(om * m) / sum(om)) * (sum(om * m) / sum(om))) AS a,
      sum(om * m) / sum(om) AS m0, sum(om * y) / sum(om) AS y0 FROM ({m}) GROUP BY series_id)"""
    wtau = f"(CASE WHEN series_id % 2 = 0 THEN acos({_D('0.3')}) ELSE {_D(repr(2 * math.pi))} - acos({_D('0.3')}) END) / {_D(repr(2 * math.pi))}"
    x = f"(t * {_D(ONE)} - sh)"
    pred = f"pr AS (SELECT series_id, t, y, dy, ybar, chi2_ref, ({_D(50)} + CAST(series_id % 7 AS DOUBLE)) * ({_value(f'{x} - floor{x}', FIRST)}) + ybar AS yfit FROM (SELECT obs.*, ybar, chi2_ref, {wtau.replace('series_id', 'obs.series_id')} AS sh FROM obs JOIN st ON obs.series_id = st.series_id))"
    sam = "sam AS (SELECT user_id AS template_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, value AS val FROM events)"
    ang = f"{_D(repr(2 * math.pi))} * CAST(h AS DOUBLE) * CAST(idx AS DOUBLE) / CAST(size AS DOUBLE)"
    fou = f"""sz AS (SELECT template_id, count(*) AS size FROM sam GROUP BY template_id),
      fo AS (SELECT template_id, h AS n, 2 / CAST(max(size) AS DOUBLE) * sum(val * cos({ang})) AS c, 2 / CAST(max(size) AS DOUBLE) * sum(val * sin({ang})) AS s
        FROM (SELECT sam.*, size, unnest(range(1, size // 2 + 1)) AS h FROM sam JOIN sz ON sam.template_id = sz.template_id) GROUP BY template_id, h)"""
    cum = "SELECT *, sum(c * c + s * s) OVER (PARTITION BY template_id ORDER BY n) AS cum, sum(c * c + s * s) OVER (PARTITION BY template_id) AS total FROM fo"
    slow = f"""sl AS (SELECT series_id, freq, p, y, 1 / (dy * dy) AS om, {_value(fold('t', 'freq') + f' - CAST(p AS DOUBLE) / {_D(10)}', FIRST)} AS m FROM obs CROSS JOIN gr CROSS JOIN range(0, 10) r(p)),
      co AS (SELECT series_id, freq, p, regr_slope(y, m) AS a, regr_intercept(y, m) AS c FROM sl GROUP BY series_id, freq, p),
      ch AS (SELECT sl.series_id, sl.freq, sl.p, sum(om * (y - a * m - c) * (y - a * m - c)) AS chi2 FROM sl JOIN co ON sl.series_id = co.series_id AND sl.freq = co.freq AND sl.p = co.p GROUP BY ALL)"""
    s1 = ", ".join(f"{_r(c)} AS {c}" for c in ("freq", "c1", "s1", "c2", "s2", "yc1", "ys1"))
    s4 = ", ".join(f"{_r(n)} AS {n}" for n in sums.covariances(2))
    every = "au AS (SELECT series_id, k, df * CAST(1 + k AS DOUBLE) AS freq FROM (SELECT series_id, df, unnest(range(0, CAST(floor({0} * n) AS BIGINT))) AS k FROM ({1})))".format(_D("12.5"), auto)
    same = "ag AS (SELECT st.series_id, gr.k, gr.freq FROM st CROSS JOIN gr)"
    single = f"a1 AS (SELECT series_id, 0 AS k, {_D(ONE)} AS freq FROM st)"
    power = f"series_id, k, {_r('freq')} AS freq, {_r('power', '1e5')} AS power"
    params = ", ".join(f"{_r(x, '1e3')} AS {x}" for x in ("a", "b", "c", "theta"))
    model = f"series_id, CAST(ordinal AS BIGINT) AS ordinal, {_r('freq')} AS freq, {_r('power', '1e5')} AS power, {params}"
    first = f"{_D(3)} + {_D(2)} * ({_value(fold('t', _D(ONE)) + ' - ' + _D('0.2'), FIRST)})"
    kept = lambda name, a, b: f"""{name} AS (SELECT series_id, {a} AS a, 1 - sum((y - yfit) * (y - yfit) / (dy * dy)) / max(chi2_ref) AS power FROM (SELECT series_id, t, y, dy, chi2_ref,
      {a} * ({_value(f"(t * {_D(ONE)} - sh) - floor(t * {_D(ONE)} - sh)", FIRST)}) + ybar AS yfit FROM (SELECT obs.*, ybar, chi2_ref,
      (CASE WHEN obs.series_id % 2 = 0 THEN acos({_D(b)}) ELSE {_D(repr(2 * math.pi))} - acos({_D(b)}) END) / {_D(repr(2 * math.pi))} AS sh FROM obs JOIN st ON obs.series_id = st.series_id)) GROUP BY series_id)"""  # noqa: E731
    return {
        "m2_exact_power_h3": with_(same, _definition(3, "ag", "cq"), _best_phase(FIRST, "cq", "f1")) + f"SELECT {power} FROM f1",
        "e6_autopower": with_(every, _definition(3, "au", "cq"), _best_phase(FIRST, "cq", "f1")) + f"SELECT {power} FROM f1",
        "e8_best_models": with_(every, _definition(3, "au", "cq"), _best_phase(FIRST, "cq", "f1")) + f"SELECT {model} FROM (SELECT *, 0 AS ordinal FROM f1 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY power DESC NULLS LAST, freq) = 1)",
        "e5_fit_model": with_(single, _definition(3, "a1", "cq"), _best_phase(FIRST, "cq", "f1")) + f"SELECT {model} FROM (SELECT *, 0 AS ordinal FROM f1)",
        "e7_power": with_(f"ar AS (SELECT series_id, k, {_D('0.5')} + {_D('0.2')} * CAST(k AS DOUBLE) AS freq FROM st CROSS JOIN range(0, 6) r(k))", _definition(3, "ar", "cq"), _best_phase(FIRST, "cq", "f1")) + f"SELECT {power} FROM f1",
        "x4_single_template": with_(same, _definition(3, "ag", "cq"), _best_phase(SECOND, "cq", "f2")) + f"SELECT {power} FROM f2",
        "g2_mixed_template": "WITH m AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {_D(repr(0.3 * a + 0.7 * c))}, {_D(repr(0.3 * b + 0.7 * d))})" for n, (a, b, c, d) in enumerate(zip(FIRST.c, FIRST.s, SECOND.c, SECOND.s), 1)) + f""") v(n, c, s))
          SELECT CAST(n AS BIGINT) AS n, {_r('c / nn')} AS c, {_r('s / nn')} AS s FROM (SELECT *, sqrt(sum(c * c + s * s) OVER ()) AS nn FROM m)""",
        "x2_fit_model": with_(single, _definition(3, "a1", "cq"), _best_phase(FIRST, "cq", "f1"), _best_phase(SECOND, "cq", "f2"))
        + f"SELECT {model} FROM (SELECT * FROM (SELECT *, 0 AS ordinal FROM f1 UNION ALL SELECT *, 1 FROM f2) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY power DESC NULLS LAST, ordinal) = 1)",
        "x3_multi_autopower": with_(every, _definition(3, "au", "cq"), _best_phase(FIRST, "cq", "f1"), _best_phase(SECOND, "cq", "f2"))
        + f"SELECT {power} FROM (SELECT f1.series_id, f1.k, f1.freq, greatest(f1.power, f2.power) AS power FROM f1 JOIN f2 ON f1.series_id = f2.series_id AND f1.k = f2.k)",
        "e8_save_best_model": with_(kept("o", f"({_D(50)} + CAST(series_id % 7 AS DOUBLE))", "0.3"), kept("q", f"({_D(40)} + CAST(series_id % 5 AS DOUBLE))", "-0.2"))
        + f"SELECT o.series_id, CASE WHEN q.power > o.power THEN q.a ELSE o.a END AS a, CASE WHEN q.power > o.power THEN {_D('-0.2')} ELSE {_D('0.3')} END AS b FROM o JOIN q ON o.series_id = q.series_id",
        "l3_refined_slow_power": with_(_least_slow(FIRST)) + f"SELECT ls.series_id, ls.k, {_r('freq')} AS freq, {_r('1 - chi2 / chi2_ref', '1e4')} AS power FROM ls JOIN st ON ls.series_id = st.series_id JOIN gr ON ls.k = gr.k",
        "s4_fast_sums": with_(_sums(1)) + f"SELECT series_id, {s1} FROM su",
        "p9_uneven_grid": f"""SELECT series_id, CAST(8 AS BIGINT) AS nf, {_r(_D('0.61') + ' - ' + _D('0.5'))} AS df, CAST(floor({_D('0.5')} / ({_D('0.61')} - {_D('0.5')}) + {_D('0.5')}) AS BIGINT) AS dnf, false AS regular FROM (SELECT DISTINCT user_id AS series_id FROM events)""",
        "p10_missing_errors": f"""WITH x AS (SELECT user_id AS series_id, value AS y, CASE WHEN event_id % 3 > 0 THEN {_D(1)} + {_D('0.25')} * CAST(event_id % 5 AS DOUBLE) ELSE {_D(1)} END AS dy FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
          m AS (SELECT series_id, count(*) AS n, sum(1 / (dy * dy)) AS wsum, sum(y / (dy * dy)) / sum(1 / (dy * dy)) AS ybar FROM x GROUP BY series_id)
          SELECT m.series_id, any_value(n) AS n, {_r('any_value(wsum)')} AS wsum, {_r('any_value(ybar)')} AS ybar, {_r('sum((y - ybar) * (y - ybar) / (dy * dy)) / any_value(wsum)', '1e3')} AS yy FROM x JOIN m ON x.series_id = m.series_id GROUP BY m.series_id""",
        "t6_reversed_samples": f"WITH {sam.replace('ORDER BY event_id', 'ORDER BY event_id DESC')}, {fou} SELECT template_id, n, {_r('c / nn')} AS c, {_r('s / nn')} AS s FROM (SELECT *, sqrt(sum(c * c + s * s) OVER (PARTITION BY template_id)) AS nn FROM fo WHERE n <= 5)",
        "g1_inject_signal": with_() + f"SELECT series_id, {_r('t')} AS t, {_r(f'{first} + {_D(0.1)} * sin(t * {_D(1000)})')} AS y FROM obs",
        "g4_inject_and_recover": with_() + f"SELECT series_id, CAST(0 AS BIGINT) AS ordinal, {_D(ONE)} AS freq, {_D(1)} AS power, {_D(2)} AS a, {_r(f'cos({_D(repr(0.4 * math.pi))})', '1e3')} AS b, {_D(3)} AS c, {_r(_D(repr(0.4 * math.pi)), '1e3')} AS theta FROM st",
        "g5_folded_overlay": with_(pred) + f"SELECT series_id, {_r(fold('t', _D(ONE)))} AS phase, y, {_r('yfit')} AS yfit FROM pr",
        "p1_observations": with_() + f"SELECT series_id, {_r('t')} AS t, y, dy FROM obs",
        "p2_weights": with_() + f"SELECT series_id, {_r('t')} AS t, {_r('w')} AS w, {_r('yc')} AS yc FROM wt",
        "p3_weighted_stats": with_() + f"SELECT series_id, n, {', '.join(f'{_r(c)} AS {c}' for c in ('tmin', 'tmax', 'ybar'))}, {_r('yy', '1e3')} AS yy, {_r('chi2_ref', '1e3')} AS chi2_ref FROM st",
        "p5_order_violations": "SELECT user_id AS series_id, CAST(coalesce(sum(CAST(before > ts AS BIGINT)), 0) AS BIGINT) AS n_violations FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY user_id",
        "p9_grid_check": with_() + f"SELECT series_id, CAST(floor({_D('12.5')} * n) AS BIGINT) AS nf, {_r('df')} AS df, CAST(1 AS BIGINT) AS dnf, true AS regular FROM ({auto})",
        "p11_phase_fold": with_() + f"SELECT series_id, {_r('t')} AS t, {_r(fold(f't - {_D(10)}', _D('0.3')))} AS phase FROM obs",
        "f1_autofrequency": with_() + f"SELECT series_id, k, {_r('df * CAST(1 + k AS DOUBLE)')} AS freq FROM (SELECT series_id, df, unnest(range(0, CAST(floor({_D('12.5')} * n) AS BIGINT))) AS k FROM ({auto}))",
        "f1_autofrequency_minmax_compat": with_() + f"""SELECT series_id, k, {_r('df * CAST(nf0 + k AS DOUBLE)')} AS freq FROM (SELECT series_id, df, nf0, unnest(range(0, CAST(ceil({_D('1.5')} / df - nf0) AS BIGINT))) AS k
            FROM (SELECT *, least(1, CAST(floor({_D('0.2')} / df) AS BIGINT)) AS nf0 FROM ({auto})))""",
        "s1_direct_sums": with_(_sums(1)) + f"SELECT series_id, {s1} FROM su",
        "s4_covariance_matrices": with_(_cov(2)) + f"SELECT series_id, {_r('freq')} AS freq, {s4} FROM cv",
        "m3_floating_mean_power": with_(_cov(1), _closed()) + f"SELECT series_id, {_r('freq')} AS freq, {_r('power')} AS power FROM h1",
        "m4_phase_grid_power_h3": with_(_cov(3), _phase_power(FIRST, "a")) + f"SELECT series_id, {_r('freq')} AS freq, {_r('power')} AS power FROM a",
        "m7_power_from_fit": with_(pred) + f"SELECT series_id, {_r('1 - sum((y - yfit) * (y - yfit) / (dy * dy)) / max(chi2_ref)')} AS power FROM pr GROUP BY series_id",
        "m8_amplitude_offset": with_(lin) + f"SELECT series_id, {_r('a')} AS amplitude, {_r('y0 - a * m0')} AS \"offset\" FROM lin",
        "m9_chi2": with_(lin) + f"SELECT z.series_id, {_r('sum(om * (y - y0 - a * (m - m0)) * (y - y0 - a * (m - m0)))', '1e3')} AS chi2 FROM ({m}) z JOIN lin ON z.series_id = lin.series_id GROUP BY z.series_id",
        "e2_model_eval": with_(pred) + f"SELECT series_id, {_r('t')} AS t, {_r('yfit')} AS yfit FROM pr",
        "t1_normalise": f"WITH {sam} SELECT template_id, idx + 1 AS n, {_r('val / nn')} AS c, {_r('val / 2 / nn')} AS s FROM (SELECT *, sqrt(sum(val * val + val / 2 * val / 2) OVER (PARTITION BY template_id)) AS nn FROM sam)",
        "t2_from_sampled": f"WITH {sam}, {fou} SELECT template_id, n, {_r('c / nn')} AS c, {_r('s / nn')} AS s FROM (SELECT *, sqrt(sum(c * c + s * s) OVER (PARTITION BY template_id)) AS nn FROM fo WHERE n <= 5)",
        "t3_auto_harmonics": f"WITH {sam}, {fou} SELECT template_id, greatest(1, count(*) FILTER (cum < {_D('0.9')} * total))::BIGINT AS h FROM ({cum}) GROUP BY template_id",
        "t4_eval": with_() + f"SELECT series_id, {_r('t')} AS t, {_r(_value(fold('t', _D(ONE)), FIRST))} AS value FROM obs",
        "g3_shifted_template": with_() + f"SELECT series_id, {_r('t')} AS t, {_r(_value(fold('t', _D(ONE)) + ' - ' + _D('0.2'), FIRST))} AS value FROM obs",
        "w1_best_frequency": with_(_cov(1), _closed()) + f"SELECT series_id, {_r('freq')} AS freq, power FROM (SELECT series_id, freq, {_r('power')} AS power, row_number() OVER (PARTITION BY series_id ORDER BY {_r('power')} DESC NULLS LAST, freq) AS k FROM h1) WHERE k = 1",
        "x5_multi_template_max": with_(_cov(3), _phase_power(FIRST, "a"), _phase_power(SECOND, "b")) + f"SELECT a.series_id, {_r('a.freq')} AS freq, {_r('greatest(a.power, b.power)')} AS power FROM a JOIN b ON a.series_id = b.series_id AND a.freq = b.freq",
        "l2_slow_chi2_grid": with_(slow) + f"SELECT series_id, {_r('freq')} AS freq, p, {_r('chi2', '1e3')} AS chi2 FROM ch",
        "l4_slow_power": with_(slow) + f"SELECT ch.series_id, {_r('freq')} AS freq, {_r('1 - min(chi2) / max(chi2_ref)')} AS power FROM ch JOIN st ON ch.series_id = st.series_id GROUP BY ch.series_id, freq",
    }
