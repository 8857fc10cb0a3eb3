"""Searches: whole plans from observations to periodograms and best models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fit as fits
from ..operators.grid import autofrequency, even_grid, grid_shape, user_grid
from ..operators.prepare import order_violations, series_stats
from ..operators.storage import settled
from ..operators.templates import Template


@dataclass
class TemplateModel:
    """The fit of a template to every series: params (series_id, freq, a, b, c, sgn)."""

    template: Template
    params: DataFrame

    def __post_init__(self):
        if not isinstance(self.template, Template):
            raise TypeError("template must be a Template")
        if not isinstance(self.params, DataFrame):
            raise TypeError("params must be a DataFrame")

    def __call__(self, obs: DataFrame) -> DataFrame:
        return fits.predict(obs, self.params, self.template)


class MultiTemplateSearch:
    """Searches all series of a table for the period at which the best of some templates fits best.

    Fits that a best model is taken from are persisted, so that power and model are computed once; ``close`` lets go of
    them. The best model itself is a written table, so searches that follow each other neither repeat its fits nor grow its plan.
    """

    def __init__(self, templates: list[Template] | None = None, allow_negative_amplitudes: bool = True):
        self.templates, self.allow_negative = templates, allow_negative_amplitudes
        self.obs = self.stats = self.best_model = None
        #: The templates that best_model's ordinals count.
        self.known: list[Template] = []
        self._held: list[DataFrame] = []

    def fit(self, obs: DataFrame, ordinal: str | None = None) -> MultiTemplateSearch:
        """obs: (series_id, t, y, dy). An earlier best model stays until a better one is found.

        Sums need no order; with ordinal, a column that numbers the rows of a series, times that go back are an error.
        """
        if ordinal is not None and not order_violations(obs, ordinal).where("n_violations > 0").isEmpty():
            raise ValueError("times must not decrease")
        self.obs, self.stats = obs, series_stats(obs)
        return self

    def close(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held = []

    def _hold(self, df: DataFrame) -> DataFrame:
        self._held.append(df.persist())
        return df

    def _data(self) -> None:
        if self.obs is None:
            raise ValueError("call fit first")

    def _ready(self) -> None:
        self._data()
        if not self.templates or not all(isinstance(t, Template) for t in self.templates):
            raise ValueError("templates must be Templates, one at least")

    def autofrequency(self, **options) -> DataFrame:
        self._data()
        return autofrequency(self.stats, **options)

    def save_best_model(self, new: DataFrame, overwrite: bool = False) -> None:
        """new: (series_id, ordinal, freq, a, b, c, sgn, ...) replaces the best model of each series that it explains strictly better."""
        if self.best_model is not None and not overwrite:
            new = merge_best(self.best_model, new, self.obs, self.stats, self.known)
        self.best_model = settled(new)

    def _power(self, grid: DataFrame, templates: list[Template], save: bool, fast: bool) -> DataFrame:
        if not save:
            return fits.exact_power(self.obs, grid, templates, self.allow_negative, self.stats, fast, "power")
        found = self._hold(fits.exact_power(self.obs, grid, templates, self.allow_negative, self.stats, fast))
        self.known += [t for t in templates if t not in self.known]
        place = F.element_at(F.array(*(F.lit(self.known.index(t)) for t in templates)), F.col("ordinal") + 1)
        self.save_best_model(fits.best(found).withColumn("ordinal", place))
        return fits.best_template(found)

    def _grid(self, freqs, fast: bool) -> DataFrame:
        if not fast:
            return user_grid(self.obs.sparkSession, freqs)
        step, first, count = even_grid(freqs)
        return self.stats.select("series_id", F.lit(step).alias("df"), F.lit(first).cast("long").alias("nf0"), F.lit(count).cast("long").alias("nf"))

    def autopower(self, save_best_model: bool = True, fast: bool = True, **options) -> DataFrame:
        """(series_id, k, freq, power) on the automatic grid."""
        self._ready()
        return self._power(grid_shape(self.stats, **options), self.templates, save_best_model, fast)

    def power(self, freqs, save_best_model: bool = True, fast: bool = False) -> DataFrame:
        """(series_id, k, freq, power) at given frequencies, a number or an array of any shape: k is the place in it, flattened.

        fast takes the sums by fast transforms, for which the frequencies must be an even grid of multiples of their step.
        """
        self._ready()
        return self._power(self._grid(freqs, fast), self.templates, save_best_model, fast)

    def power_from_single_template(self, freqs, template: Template, fast: bool = False, save_best_model: bool = True) -> DataFrame:
        """``power`` of one template, which need not be among the search's own."""
        self._data()
        return self._power(self._grid(freqs, fast), [template], save_best_model, fast)

    def fit_model(self, freq: float) -> DataFrame:
        """The best template's parameters of each series at one frequency."""
        self._ready()
        if not isinstance(freq, float):
            raise ValueError("freq must be a float")
        return fits.exact_power(self.obs, user_grid(self.obs.sparkSession, [freq]), self.templates, self.allow_negative, self.stats, False, "best")


class TemplateSearch(MultiTemplateSearch):
    """The search with one template."""

    def __init__(self, template: Template | None = None, allow_negative_amplitudes: bool = True):
        super().__init__(None if template is None else [template], allow_negative_amplitudes)

    def fit_model(self, freq: float) -> TemplateModel:
        return TemplateModel(self.templates[0], super().fit_model(float(freq))) if self.templates else super().fit_model(float(freq))


class GridTemplateSearch:
    """The plain search over phases, with unweighted linear fits; for comparison. refine goes on from the best phases to the least."""

    def __init__(self, template: Template, phases: int = 20, refine: bool = True):
        self.template, self.phases, self.refine, self.obs = template, phases, refine, None

    def fit(self, obs: DataFrame) -> GridTemplateSearch:
        self.obs, self.stats = obs, series_stats(obs)
        return self

    def power(self, freqs) -> DataFrame:
        if self.obs is None:
            raise ValueError("call fit first")
        slow = fits.refined_slow_power if self.refine else fits.slow_power
        return slow(self.obs, user_grid(self.obs.sparkSession, freqs), self.template, self.stats, self.phases)


def merge_best(old: DataFrame, new: DataFrame, obs: DataFrame, stats: DataFrame, templates: list[Template]) -> DataFrame:
    """Of each series the old best model, unless the new one explains strictly more of the present data."""

    def scored(models: DataFrame) -> DataFrame:
        parts = None
        for k, t in enumerate(templates):
            own = models.where(F.col("ordinal") == k)
            part = fits.power_from_fit(fits.predict(obs, own, t), stats)
            parts = part if parts is None else parts.union(part)
        return models.join(parts.withColumnRenamed("power", "now"), "series_id", "left")

    a, b = scored(old).withColumn("age", F.lit(0)), scored(new).withColumn("age", F.lit(1))
    both = a.unionByName(b)
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc_nulls_last("now"), "age"))
    return both.withColumn("rank", rank).where("rank = 1").select(*new.columns)
