"""Statistics of a numeric column within the levels of a categorical one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import State, Transformer, fill, number, register_transformer, text
from ..roles import finite


class GroupStatistic(Transformer):
    """A dictionary from level (null is one) to statistics, with global ones for other levels."""

    arity, input_type, n_inputs = "mixed_binary", "mixed", (2, 2)
    empty: float | None = None  # the default where no value is known at all

    def statistics(self, gene, x):
        raise NotImplementedError

    def key(self, gene):
        return text(gene.inputs[0])

    def _all(self, gene):
        return self.statistics(gene, finite(number(gene.inputs[1])))

    def grouped(self, gene, target):
        return self._all(gene)

    def totals(self, gene, target):
        return self._all(gene)

    def finish(self, gene, totals, groups, target):
        return State(values={k: self.empty if v is None else v for k, v in totals.items()}, columns=list(totals), table=groups)

    def value(self, state, found, name):
        default = state.values[name]
        return F.coalesce(found[name], F.lit(default).cast("double"))

    def column(self, gene, state, found):
        return self.value(state, found, next(iter(state.values)))


class GroupMean(GroupStatistic):
    name = "groupby_mean"

    def statistics(self, gene, x):
        return {"mean": F.avg(x)}


class GroupSd(GroupStatistic):
    name = "groupby_sd"

    def statistics(self, gene, x):
        return {"sd": F.coalesce(F.stddev_samp(x), F.lit(0.0))}


class GroupMax(GroupStatistic):
    name, empty = "groupby_max", 0.0

    def statistics(self, gene, x):
        return {"max": F.max(x)}


class GroupMin(GroupStatistic):
    name, empty = "groupby_min", 0.0

    def statistics(self, gene, x):
        return {"min": F.min(x)}


class GroupMedian(GroupStatistic):
    name, empty = "groupby_median", 0.0

    def statistics(self, gene, x):
        return {"median": F.percentile(x, F.lit(0.5))}


class GroupQuantile(GroupStatistic):
    name, empty = "groupby_quantile", 0.0

    def sample_params(self, rng, n_inputs):
        return {"q": rng.choice([0.25, 0.75])}

    def statistics(self, gene, x):
        return {"quantile": F.percentile(x, F.lit(float(gene.options.get("q", 0.25))))}


class GroupRatio(GroupMean):
    name = "groupby_ratio"

    def column(self, gene, state, found):
        x, mean = number(gene.inputs[1]), self.value(state, found, "mean")
        return fill(F.when(mean == 0, F.lit(0.0)).otherwise(F.try_divide(x, mean)), 0.0)


class GroupZscore(GroupStatistic):
    name = "groupby_zscore"

    def statistics(self, gene, x):
        return {"mean": F.avg(x), "sd": F.coalesce(F.stddev_samp(x), F.lit(0.0))}

    def column(self, gene, state, found):
        x, mean, sd = number(gene.inputs[1]), self.value(state, found, "mean"), self.value(state, found, "sd")
        return fill(F.when(sd == 0, F.lit(0.0)).otherwise(F.try_divide(x - mean, sd)), 0.0)


class GroupSignedLog(GroupMean):
    name, empty = "groupby_signed_log", 0.0

    def column(self, gene, state, found):
        d = number(gene.inputs[1]) - self.value(state, found, "mean")
        return fill(F.signum(d) * F.log1p(F.abs(d)), 0.0)


for kind in (GroupMean, GroupSd, GroupMax, GroupMin, GroupRatio, GroupZscore, GroupMedian, GroupQuantile, GroupSignedLog):
    register_transformer(kind())
