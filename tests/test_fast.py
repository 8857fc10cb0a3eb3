"""Fast sums, user grids, saved models, unusual inputs and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel import streaming
from tidewheel.functions.kernel import grid_sums, trig_sums
from tidewheel.operators import fit, grid, prepare
from tidewheel.operators.templates import Template
from tidewheel.plans import GridTemplateSearch, MultiTemplateSearch, TemplateSearch
from tidewheel.sources.observations import observations

FIRST, SECOND = Template((-0.181, -0.1, -0.02), (-0.11, 0.0, 0.03)), Template((0.2, 0.0, 0.2), (0.2, 0.2, 0.0))
SCHEMA = "series_id string, t double, y double, dy double"


def rows(name, n, seed, freq=0.9, noise=0.5):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 30, n))
    return [(name, float(a), float(b), float(c)) for a, b, c in zip(t, 5 + 10 * FIRST(t * freq - 0.3) + noise * rng.normal(size=n), 0.5 + rng.uniform(size=n))]


@pytest.mark.parametrize("h", [1, 3, 5])
@pytest.mark.parametrize("n, count, first", [(30, 750, 1), (400, 4001, 0), (3, 17, 5)])
def test_fast_sums_are_direct_sums(h, n, count, first):
    rng = np.random.default_rng(h)
    t, w = np.sort(rng.uniform(-50, 5, n)), rng.uniform(0.5, 1, n)
    w, y = w / w.sum(), rng.normal(size=n)
    step = 1 / (t[-1] - t[0]) / 5
    direct = trig_sums(t, w, y, step * (first + np.arange(count)), h)
    assert np.allclose(grid_sums(t, w, y, step, first, count, h), direct, rtol=1e-7, atol=1e-10)


def test_fast_and_direct_power_agree_and_names_are_kept(spark):
    obs = spark.createDataFrame(rows("lc-1", 900, 1) + rows("lc-2", 20, 2), SCHEMA)
    stats = prepare.series_stats(obs)
    shape = grid.grid_shape(stats)
    got = {fast: {(r["series_id"], r["k"]): r["power"] for r in fit.exact_power(obs, shape, [FIRST], stats=stats, fast=fast).collect()} for fast in (True, False)}
    assert got[True].keys() == got[False].keys() and {k[0] for k in got[True]} == {"lc-1", "lc-2"}
    assert max(abs(got[True][k] - got[False][k]) for k in got[True]) < 1e-8


def test_long_series_in_chunks_and_blocks(spark, monkeypatch):
    obs = spark.createDataFrame(rows("a", 300, 3) + rows("a", 300, 3)[:40], SCHEMA)
    stats = prepare.series_stats(obs)
    whole = {r["k"]: r["power"] for r in fit.exact_power(obs, grid.grid_shape(stats), [FIRST], stats=stats).collect()}
    monkeypatch.setattr(fit, "OBSERVATIONS", 64)
    monkeypatch.setattr(fit, "FREQUENCIES", 100)
    monkeypatch.setattr(fit, "MOST_FREQUENCIES", 500)
    cut = {r["k"]: r["power"] for r in fit.exact_power(obs, grid.grid_shape(stats), [FIRST], stats=stats).collect()}
    assert cut.keys() == whole.keys() and max(abs(cut[k] - whole[k]) for k in cut) < 1e-9


def test_errors_of_zero_and_missing_ones(spark):
    raw = spark.createDataFrame([(1, 0.0, 1.0, 0.0), (1, 1.0, 2.0, float("nan")), (1, 2.0, 3.0, None), (1, 3.0, 5.0, -0.5), (None, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0)], "i int, t double, y double, e double")
    got = sorted(tuple(r) for r in observations(raw, "i", "t", "y", "e").collect())
    assert got == [(1, 2.0, 3.0, 1.0), (1, 3.0, 5.0, -0.5)]
    assert prepare.series_stats(spark.createDataFrame([("a", 0.0, 1.0, 0.0), ("a", 1.0, 2.0, 1.0)], SCHEMA)).first()["wsum"] == 1.0


def test_grids_of_any_shape(spark):
    search = TemplateSearch(FIRST).fit(spark.createDataFrame(rows("a", 60, 4), SCHEMA))
    flat = [r["power"] for r in search.power([0.5, 0.7, 0.9, 1.1], save_best_model=False).orderBy("k").collect()]
    square = [r["power"] for r in search.power(np.array([[0.5, 0.7], [0.9, 1.1]]), save_best_model=False).orderBy("k").collect()]
    assert flat == pytest.approx(square) and search.power(0.9, save_best_model=False).first()["power"] == pytest.approx(flat[2])
    even = [r["power"] for r in search.power(0.1 * np.arange(1, 20), save_best_model=False, fast=True).orderBy("k").collect()]
    assert even == pytest.approx([r["power"] for r in search.power(0.1 * np.arange(1, 20), save_best_model=False).orderBy("k").collect()])
    for bad in ([0.5], [0.1, 0.25, 0.3], [0.15, 0.25, 0.35]):
        with pytest.raises(ValueError):
            search.power(bad, fast=True)


def test_single_template_saves_its_model_and_plans_stay_small(spark):
    search = MultiTemplateSearch([SECOND]).fit(spark.createDataFrame(rows("a", 60, 5), SCHEMA))
    search.power([0.3, 0.9])
    poor = search.best_model.first()
    search.power_from_single_template([0.9], FIRST, save_best_model=False)
    assert tuple(search.best_model.first()) == pytest.approx(tuple(poor))
    search.power_from_single_template([0.2, 0.9], FIRST)
    best = search.best_model.first()
    assert search.known[best["ordinal"]] == FIRST and best["freq"] == 0.9 and best["power"] > poor["power"]
    for _ in range(3):
        search.power([0.3, 0.4])
    assert tuple(search.best_model.first()) == pytest.approx(tuple(best))
    assert search.best_model._jdf.queryExecution().executedPlan().toString().count("MapInArrow") < 60
    search.close()


def test_refined_slow_search(spark):
    obs = spark.createDataFrame(rows("a", 50, 6), SCHEMA)
    freqs = np.linspace(0.05, 1.5, 25)
    slow = [r["power"] for r in GridTemplateSearch(FIRST).fit(obs).power(freqs).orderBy("k").collect()]
    rough = [r["power"] for r in GridTemplateSearch(FIRST, refine=False).fit(obs).power(freqs).orderBy("freq").collect()]
    fast = [r["power"] for r in TemplateSearch(FIRST).fit(obs).power(freqs, save_best_model=False).orderBy("k").collect()]
    assert all(r - 1e-9 <= s <= f + 1e-9 for r, s, f in zip(rough, slow, fast)) and max(s - r for r, s in zip(rough, slow)) > 1e-5
    exact = spark.createDataFrame(rows("b", 50, 7, noise=0.0), SCHEMA)
    assert GridTemplateSearch(FIRST).fit(exact).power(0.9).first()["power"] == pytest.approx(1.0, abs=1e-9)


def test_streams_of_observations(spark, tmp_path):
    data = rows("a", 200, 8) + rows("b", 100, 9)
    obs = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], SCHEMA + ", i int").withColumn("ts", F.timestamp_seconds(F.col("t") * 86400))
    for k in range(3):
        obs.where(F.col("i") % 3 == k).drop("i").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    freqs = [0.5, 0.9, 1.3]
    stream = spark.readStream.schema(obs.drop("i").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streaming.running_sums(stream, freqs, 3).writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination(120)
    got = {(r["series_id"], r["freq"]): r for r in streaming.fits_of(spark.table("sums"), FIRST).collect()}
    plain = obs.select("series_id", "t", "y", "dy")
    want = fit.exact_power(plain, grid.user_grid(spark, freqs), [FIRST]).collect()
    assert len(got) == len(want) == 6 and all(got[r["series_id"], r["freq"]]["power"] == pytest.approx(r["power"]) for r in want)
    late = streaming.windowed_sums(stream, freqs, 1, "ts", "10 days", "5 days").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/d").start()
    late.awaitTermination(120)
    closed = streaming.fits_of(spark.table("windows"), Template((1.0,), (0.0,))).collect()
    assert closed and all(0 <= r["power"] <= 1 for r in closed)


def test_order_of_times(spark):
    obs = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 0), ("a", 1.0, 2.0, 1.0, 1), ("a", 3.0, 0.0, 1.0, 2)], SCHEMA + ", i int")
    TemplateSearch(FIRST).fit(obs, "i")
    with pytest.raises(ValueError):
        TemplateSearch(FIRST).fit(obs.withColumn("t", -F.col("t")), "i")
