import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions.kernel import best_phase, matrices, trig_sums
from tidewheel.operators import fit, grid, prepare
from tidewheel.operators.templates import Template, from_sampled, mixed, template_table
from tidewheel.plans import GridTemplateSearch, MultiTemplateSearch, TemplateModel, TemplateSearch

RNG = np.random.default_rng(3)


def series(n=40, freq=0.9, template=None, amp=10.0, noise=0.0):
    template = template or Template((-0.181, -0.1, -0.02), (-0.11, 0.0, 0.03))
    t = np.sort(RNG.uniform(0, 12, n))
    return t, 5 + amp * template(t * freq - 0.3) + noise * RNG.normal(size=n), 0.5 + RNG.uniform(size=n)


def frame(spark, many):
    rows = [(k, float(a), float(b), float(c)) for k, s in many.items() for a, b, c in zip(*s)]
    return spark.createDataFrame(rows, "series_id long, t double, y double, dy double")


def moments(t, y, dy):
    w = dy**-2 / (dy**-2).sum()
    ybar = w @ y
    return w, y - ybar, ybar, w @ (y - ybar) ** 2


@pytest.mark.parametrize("h", [1, 2, 3, 5])
def test_sums_and_covariances(h):
    t, y, dy = series()
    w, yc, _, _ = moments(t, y, dy)
    freqs = np.array([0.1, 0.55, 1.7])
    cov, with_y, mean = matrices(trig_sums(t, w, yc, freqs, h), h)
    for f, c, v, m in zip(freqs, cov, with_y, mean):
        x = 2 * np.pi * f * np.outer(np.arange(1, h + 1), t)
        z = np.concatenate([np.cos(x), np.sin(x)])
        assert np.allclose(m, z @ w) and np.allclose(v, z @ (w * yc))
        assert np.allclose(c, (z * w) @ z.T - np.outer(z @ w, z @ w)) and np.allclose(c, c.T)


@pytest.mark.parametrize("h", [1, 2, 3, 5])
def test_best_phase_is_the_maximum(h):
    rng = np.random.default_rng(h)
    template = Template(tuple(rng.normal(size=h)), tuple(rng.normal(size=h)))
    t, y, dy = series(noise=3)
    w, yc, ybar, yy = moments(t, y, dy)
    freqs = np.linspace(0.05, 2, 30)
    got = best_phase(trig_sums(t, w, yc, freqs, h), template.c, template.s, ybar, yy)
    for f, (power, a, b, c, sgn, theta) in zip(freqs, got):
        dense = []
        for p in np.linspace(0, 1, 4000, endpoint=False):
            m = template(t * f - p)
            mc = m - w @ m
            dense.append((w @ (mc * yc)) ** 2 / (w @ mc**2) / yy)
        assert power >= max(dense) - 1e-9 and power <= max(dense) + 1e-4
        fitted = a * template(t * f - theta / 2 / np.pi) + c
        assert abs(1 - w @ (y - fitted) ** 2 / yy - power) < 1e-9
        assert abs(np.cos(theta) - b) < 1e-12 and sgn == np.sign(np.sin(theta))


def test_degenerate_inputs_have_no_power():
    t, y, dy = series()
    w, yc, ybar, yy = moments(t, y, dy)
    assert np.isnan(best_phase(trig_sums(t, w, yc, np.array([0.0]), 2), (1, 0.5), (0, 0), ybar, yy)).all()
    assert np.isnan(best_phase(trig_sums(t, w, yc, np.array([0.3]), 2), (1, 0.5), (0, 0), ybar, 0.0)).all()


@pytest.mark.parametrize("h", [1, 2, 3, 4])
def test_template_round_trip(spark, h):
    rng = np.random.default_rng(42)
    t = Template(tuple(rng.normal(size=h)), tuple(rng.normal(size=h)))
    y = t(np.arange(100) / 100)
    again = Template.from_sampled(y, h)
    assert np.allclose(again.c, t.c) and np.allclose(again.s, t.s)
    table = from_sampled(spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(y)], "template_id string, idx int, val double"), h)
    rows = sorted((r["n"], r["c"], r["s"]) for r in table.collect())
    assert np.allclose([r[1] for r in rows], t.c) and np.allclose([r[2] for r in rows], t.s)
    assert template_table(spark, [t]).count() == h


def test_template_errors_and_mixture():
    with pytest.raises(ValueError):
        Template((0.0,), (0.0,))
    a, b = Template((1.0,), (0.0,)), Template((0.0, 1.0), (0.0, 0.0))
    assert np.allclose(mixed(a, b, 1.0, 1).c, a.c)


def test_search_recovers_periods(spark):
    shape = Template((-0.181, -0.1, -0.02), (-0.11, 0.0, 0.03))
    obs = frame(spark, {1: series(freq=0.9), 2: series(n=60, freq=1.3)})
    search = TemplateSearch(shape).fit(obs)
    power = search.autopower(maximum_frequency=2.0, samples_per_peak=8).toPandas()
    best = {r["series_id"]: r for r in search.best_model.collect()}
    assert abs(best[1]["freq"] - 0.9) < 0.02 and abs(best[2]["freq"] - 1.3) < 0.02
    assert np.allclose(power.groupby("series_id")["power"].max(), [best[1]["power"], best[2]["power"]])
    model = search.fit_model(0.9)
    assert isinstance(model, TemplateModel)
    fitted = fit.power_from_fit(model(obs), search.stats).collect()
    assert abs(dict((r[0], r[1]) for r in fitted)[1] - 1) < 1e-6


def test_multi_is_the_best_of_singles_and_slow_is_no_better(spark):
    shapes = [Template((1.0, 0.4), (0.0, 0.3)), Template((0.2, 0.0, 0.2), (0.2, 0.2, 0.0))]
    obs = frame(spark, {5: series(noise=2)})
    freqs = [0.3, 0.9, 1.1]
    multi = MultiTemplateSearch(shapes).fit(obs)
    both = multi.power(freqs).orderBy("k").toPandas()["power"].to_numpy()
    singles = [multi.power_from_single_template(freqs, t).orderBy("k").toPandas()["power"].to_numpy() for t in shapes]
    assert np.allclose(both, np.maximum(*singles))
    slow = GridTemplateSearch(shapes[0]).fit(obs).power(freqs).orderBy("freq").toPandas()["power"].to_numpy()
    assert (slow <= singles[0] + 1e-5).all()
    best = multi.best_model.first()
    multi.power([0.3])
    assert abs(multi.best_model.first()["power"] - best["power"]) < 1e-9


def test_one_harmonic_is_the_closed_form(spark):
    obs = frame(spark, {1: series(noise=4), 2: series(noise=4, n=25)})
    stats = prepare.series_stats(obs)
    freqs = grid.user_grid(spark, [0.2, 0.7, 1.9])
    closed = fit.floating_mean_power(prepare.weighted(obs, stats), freqs, stats).orderBy("series_id", "freq").toPandas()["power"]
    exact = fit.exact_power(obs, freqs, [Template((1.0,), (0.0,))], stats=stats).orderBy("series_id", "freq").toPandas()["power"]
    assert np.allclose(closed, exact, atol=1e-9)


def test_long_series_are_cut(spark, monkeypatch):
    obs = frame(spark, {1: series(n=300, noise=3)})
    freqs = grid.user_grid(spark, [0.2, 0.7, 1.9])
    whole = fit.exact_power(obs, freqs, [Template((1.0, 0.2), (0.0, 0.1))]).orderBy("k").toPandas()
    monkeypatch.setattr(fit, "OBSERVATIONS", 40)
    monkeypatch.setattr(fit, "FREQUENCIES", 2)
    cut = fit.exact_power(obs, freqs, [Template((1.0, 0.2), (0.0, 0.1))]).orderBy("k").toPandas()
    assert np.allclose(whole["power"], cut["power"]) and len(cut) == 3


def test_errors(spark):
    with pytest.raises(ValueError):
        TemplateSearch(Template((1.0,), (0.0,))).autopower()
    with pytest.raises(ValueError):
        TemplateSearch().fit(frame(spark, {1: series()})).autopower()
    with pytest.raises(ValueError):
        MultiTemplateSearch([Template((1.0,), (0.0,))]).fit(frame(spark, {1: series()})).fit_model("x")
    with pytest.raises(TypeError):
        TemplateModel("x", None)


def test_grid_compat(spark):
    stats = spark.createDataFrame([(1, 10, 0.0, 10.0)], "series_id long, n long, tmin double, tmax double")
    shape = grid.grid_shape(stats, minimum_frequency=0.5, maximum_frequency=1.0).first()
    assert (shape["nf0"], shape["nf"]) == (1, 49)
    shape = grid.grid_shape(stats, minimum_frequency=0.5, maximum_frequency=1.0, compat=False).first()
    assert (shape["nf0"], shape["nf"]) == (25, 25)
    assert grid.inspect_grid(grid.autofrequency(stats)).first()["regular"]
    assert grid.grid_shape(stats.withColumn("tmax", F.col("tmin"))).count() == 0
