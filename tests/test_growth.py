"""What tasks hold and shuffle grows with the observations only; long series that are cut have the results of whole ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions.kernel import best_phase, least_slow_chi2
from tidewheel.operators import fit, grid, prepare
from tidewheel.operators.templates import Template
from tidewheel.plans import MultiTemplateSearch

FIRST, SECOND = Template((-0.181, -0.1, -0.02), (-0.11, 0.0, 0.03)), Template((0.2, 0.0, 0.2), (0.2, 0.2, 0.0))
SERIES, EACH = 200, 60


@pytest.fixture(scope="module")
def obs(spark, tmp_path_factory):
    x = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0
    rows = spark.range(SERIES * EACH).select((F.col("id") % SERIES).alias("series_id"), (x(1) * 30).alias("t"), (x(2) * 100).alias("y"), (x(3) + 0.5).alias("dy"))
    rows.write.parquet(path := f"{tmp_path_factory.mktemp('growth')}/obs")
    return spark.read.parquet(path)


def shuffled(spark, df) -> float:
    """MB that df's jobs write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: (spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000), sum(x.totalShuffleWrite() for x in map(store.executorList(True).apply, range(store.executorList(True).size()))))[1]
    before = written()
    df.write.format("noop").mode("overwrite").save()
    return (written() - before) / 1e6


def many(spark):
    return grid.user_grid(spark, 0.05 * np.arange(1, 41))


def test_periodograms_shuffle_observations_only(spark, obs):  # F1
    stats = prepare.series_stats(obs)
    assert shuffled(spark, fit.exact_power(obs, grid.grid_shape(stats), [FIRST], stats=stats)) < 5


def test_best_models_are_picked_where_they_are_made(spark, obs):  # F2
    search = MultiTemplateSearch([FIRST, SECOND]).fit(obs)
    found = fit.exact_power(obs, grid.grid_shape(search.stats), [FIRST, SECOND], stats=search.stats, keep="best")
    assert shuffled(spark, found) < 5
    want = fit.best(fit.exact_power(obs, grid.grid_shape(search.stats), [FIRST, SECOND], stats=search.stats))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(found.columns).collect()))


def test_power_of_several_templates_is_joined_where_it_is_made(spark, obs):  # F3
    search = MultiTemplateSearch([FIRST, SECOND]).fit(obs)
    found = search.autopower(save_best_model=False)
    assert shuffled(spark, found) < 5
    few = obs.where("series_id < 3")
    search = MultiTemplateSearch([FIRST, SECOND]).fit(few)
    want = fit.best_template(fit.exact_power(few, grid.grid_shape(search.stats), [FIRST, SECOND], stats=search.stats))
    assert sorted(map(tuple, search.autopower(save_best_model=False).collect())) == sorted(map(tuple, want.collect()))


def test_residuals_shuffle_observations_only(spark, obs):  # F4
    assert shuffled(spark, fit.unweighted_chi2(obs, many(spark), FIRST, 10)) < 5


def test_slow_power_shuffles_observations_only(spark, obs):  # F5
    assert shuffled(spark, fit.slow_power(obs, many(spark), FIRST, prepare.series_stats(obs), 10)) < 5


def test_few_frequencies_are_solved_at_once(spark, obs, monkeypatch):  # F6
    def watched(sums, *args):
        assert len(sums) <= 8192
        return best_phase(sums, *args)

    monkeypatch.setattr(fit, "best_phase", watched)
    series = obs.withColumn("series_id", F.floor(F.rand(1) * 6000)).cache()
    search = MultiTemplateSearch([FIRST]).fit(series)
    got = search.power_from_single_template([0.05 * k for k in range(1, 41)], SECOND, fast=True, save_best_model=False)
    assert got.where("k = 7").count() == series.select("series_id").distinct().count()


def test_slow_fits_of_series_are_refined_together(spark, obs, monkeypatch):  # F7
    def watched(sums, *args):
        assert len(sums) > 40, "a series alone"
        return least_slow_chi2(sums, *args)

    monkeypatch.setattr(fit, "least_slow_chi2", watched)
    assert fit.refined_slow_power(obs, many(spark), FIRST, prepare.series_stats(obs)).count() == SERIES * 40


def test_residuals_by_definition_and_of_cut_series(spark, obs, monkeypatch):
    few = obs.where("series_id < 2")
    few = few.union(few.where("t < 3"))  # some observations twice
    stats = prepare.series_stats(few)
    takes = {
        "chi2": lambda: fit.unweighted_chi2(few, many(spark), FIRST, 10), "slow": lambda: fit.slow_power(few, many(spark), FIRST, stats, 10),
        "refined": lambda: fit.refined_slow_power(few, many(spark), FIRST, stats), "exact": lambda: fit.exact_power(few, many(spark), [FIRST], stats=stats, keep="power"),
        "best": lambda: fit.exact_power(few, many(spark), [FIRST, SECOND], stats=stats, keep="best").select("series_id", "ordinal", "freq", "power"),
    }
    whole = {k: np.array(sorted(map(tuple, f().collect()))) for k, f in takes.items()}
    t, y, dy = np.array([tuple(r)[1:] for r in few.where("series_id = 1").collect()]).T
    for _, f, p, chi2 in whole["chi2"][whole["chi2"][:, 0] == 1][::37]:
        m = FIRST(t * f - p / 10)
        a, b = np.polyfit(m, y, 1)
        assert chi2 == pytest.approx((((y - a * m - b) / dy) ** 2).sum(), rel=1e-9)
    monkeypatch.setattr(fit, "OBSERVATIONS", 16)
    monkeypatch.setattr(fit, "FREQUENCIES", 7)
    for k, f in takes.items():
        assert np.allclose(np.array(sorted(map(tuple, f().collect()))), whole[k], atol=1e-7), k


def test_series_without_a_fit_have_null_power(spark):
    obs = spark.createDataFrame([(1, 0.5, 2.0, 1.0), (2, 0.5, 2.0, 1.0), (2, 0.5, 3.0, 1.0), (3, 0.0, 1.0, 1.0), (3, 1e-6, 2.0, 1.0)], "series_id long, t double, y double, dy double")
    got = {(r[0], r[2]): r[3] for r in fit.unweighted_chi2(obs, grid.user_grid(spark, [0.3]), FIRST, 4).collect()}
    assert all(got[k, p] is None for k in (1, 2) for p in range(4)) and all(got[3, p] == pytest.approx(0, abs=1e-9) for p in range(4))
    power = {r[0]: r[2] for r in fit.slow_power(obs, grid.user_grid(spark, [0.3]), FIRST, prepare.series_stats(obs), 4).collect()}
    assert power[1] is None and power[2] is None and power[3] == pytest.approx(1)
