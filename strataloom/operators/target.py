"""Supervised encoders of categorical columns."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..registry import State, Transformer, register_transformer, text

#: Pseudo-count of the smoothed encoders.
SMOOTHING = 10.0


class TargetEncoder(Transformer):
    """Smoothed statistics of the label by level; other levels get the global one."""

    arity, input_type, needs_target = "supervised_unary", "categorical", True

    def key(self, gene):
        return text(gene.inputs[0])

    def label(self, target):
        return target.value() if target is not None else None

    def statistic(self, gene, y):
        return F.avg(y)

    def totals(self, gene, target):
        y = self.label(target)
        return {} if y is None else {"g": self.statistic(gene, y)}

    def grouped(self, gene, target):
        y = self.label(target)
        return {} if y is None else {"s": self.statistic(gene, y), "n": F.count(F.lit(1))}

    def finish(self, gene, totals, groups, target):
        if not totals or totals["g"] is None:
            return State(valid=False)
        g = F.lit(float(totals["g"]))
        table = groups.select("key", ((F.col("n") * F.col("s") + SMOOTHING * g) / (F.col("n") + SMOOTHING)).alias("enc"))
        return State(values={"g": float(totals["g"])}, columns=["enc"], table=table)

    def column(self, gene, state, found):
        if not state.valid:
            return F.lit(0.0)
        # A null level has no encoding of its own.
        return F.when(text(gene.inputs[0]).isNull(), F.lit(state.values["g"])).otherwise(F.coalesce(found["enc"], F.lit(state.values["g"])))


class TargetEncode(TargetEncoder):
    name = "target_encode"


class TargetQuantileEncode(TargetEncoder):
    name = "target_quantile_encode"

    def sample_params(self, rng, n_inputs):
        return {"q": rng.choice([0.25, 0.5, 0.75])}

    def statistic(self, gene, y):
        return F.percentile(y, F.lit(float(gene.options.get("q", 0.5))))


class PooledTargetEncode(TargetEncoder):
    """Empirical Bayes: the pseudo-count is the pooled variance within levels over that between their means."""

    name = "pooled_target_encode"

    def grouped(self, gene, target):
        y = self.label(target)
        return {} if y is None else {"s": F.avg(y), "v": F.coalesce(F.var_samp(y), F.lit(0.0)), "n": F.count(y)}

    def finish(self, gene, totals, groups, target):
        if not totals or totals["g"] is None:
            return State(valid=False)
        g = float(totals["g"])
        known = groups.where(F.col("n") > 0)
        r = known.agg(F.sum((F.col("n") - 1) * F.col("v")).alias("w"), F.sum(F.col("n") - 1).alias("df"), F.coalesce(F.var_samp("s"), F.lit(0.0)).alias("between")).first()
        within = (r.w or 0.0) / r.df if r.df else 0.0
        k = within / r.between if r.between and r.between > 0 else math.inf
        enc = F.lit(g) if math.isinf(k) else (F.col("n") * F.col("s") + F.lit(k * g)) / (F.col("n") + F.lit(k))
        return State(values={"g": g, "k": k}, columns=["enc"], table=known.select("key", enc.alias("enc")))


class TargetEncodeMulticlass(TargetEncoder):
    name = "target_encode_multiclass"

    def sample_params(self, rng, n_inputs):
        return {"comp_idx": rng.randint(1, 5)}

    def components(self, gene):
        return [1, 2, 3, 4, 5]

    def indicator(self, gene, target):
        k = int(gene.options.get("comp_idx", 1))
        if target is None or k > len(target.levels):
            return None
        c = F.col(f"`{target.column}`")
        return F.when(c.isNotNull(), (c == F.lit(target.levels[k - 1])).cast("double"))

    def totals(self, gene, target):
        y = self.indicator(gene, target)
        return {} if y is None else {"g": F.avg(y)}

    def grouped(self, gene, target):
        y = self.indicator(gene, target)
        return {} if y is None else {"s": F.avg(y), "n": F.count(F.lit(1))}


class WoeEncode(TargetEncoder):
    """Weight of evidence of a binary label; other labels, or one class alone, give 0."""

    name = "woe_encode"

    def event(self, target):
        if target is None or len(target.levels) != 2:
            return None
        return F.col(f"`{target.column}`") == F.lit(target.levels[-1])

    def totals(self, gene, target):
        e = self.event(target)
        return {} if e is None else {"E": F.sum(e.cast("long")), "NE": F.sum((~e).cast("long"))}

    def grouped(self, gene, target):
        e = self.event(target)
        return {} if e is None else {"e": F.coalesce(F.sum(e.cast("long")), F.lit(0)), "ne": F.coalesce(F.sum((~e).cast("long")), F.lit(0))}

    def finish(self, gene, totals, groups, target):
        if not totals or not totals["E"] or not totals["NE"]:
            return State(valid=False)
        enc = F.log(((F.col("e") + 0.5) / (totals["E"] + 1)) / ((F.col("ne") + 0.5) / (totals["NE"] + 1)))
        return State(values={"g": 0.0}, columns=["enc"], table=groups.select("key", enc.alias("enc")))


class CatInteractionTargetEncode(TargetEncoder):
    name, arity, n_inputs = "cat_interaction_target_encode", "supervised_binary", (2, 2)

    def key(self, gene):
        return F.concat_ws("___", *[F.coalesce(text(c), F.lit("NA")) for c in gene.inputs])

    def column(self, gene, state, found):
        return F.coalesce(found["enc"], F.lit(state.values["g"])) if state.valid else F.lit(0.0)


for kind in (TargetEncode, PooledTargetEncode, TargetEncodeMulticlass, WoeEncode, TargetQuantileEncode, CatInteractionTargetEncode):
    register_transformer(kind())
