"""Bins and ranks against the training distribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.ranges import running_totals
from ..registry import State, Transformer, number, register_transformer
from ..roles import finite

#: Distinct training values that a rank keeps on the driver; more stay a table.
LOCAL_VALUES = 100_000


class QuantileBinning(Transformer):
    name = "quantile_binning"

    def sample_params(self, rng, n_inputs):
        return {"Q": rng.randint(3, 10)}

    def totals(self, gene, target):
        q = int(gene.options.get("Q", 5))
        return {"bounds": F.percentile(finite(number(gene.inputs[0])), F.array(*[F.lit(i / q) for i in range(q + 1)]))}

    def finish(self, gene, totals, groups, target):
        return State(values={"bounds": sorted(set(totals["bounds"] or []))})

    def column(self, gene, state, found):
        bounds, x = state.values["bounds"], number(gene.inputs[0])
        if len(bounds) <= 1:
            return F.lit(1).cast("int")
        passed = reduce(lambda a, b: a + b, [(x >= F.lit(b)).cast("int") for b in bounds])
        return F.coalesce(F.greatest(F.lit(1), F.least(F.lit(len(bounds) - 1), passed)), F.lit(0)) if len(bounds) > 1 else F.lit(1)


class LogBinning(Transformer):
    name = "log_binning"

    def sample_params(self, rng, n_inputs):
        return {"base": rng.randint(2, 10)}

    def column(self, gene, state, found):
        x = F.log(F.abs(number(gene.inputs[0])) + 1) / F.log(F.lit(float(gene.options.get("base", 2))))
        return F.coalesce(F.floor(finite(x)), F.lit(0)).cast("int")


class QuantileBinningCat(QuantileBinning):
    name, output_type = "quantile_binning_cat", "categorical"

    def column(self, gene, state, found):
        return super().column(gene, state, found).cast("string")


class LogBinningCat(LogBinning):
    name, output_type = "log_binning_cat", "categorical"

    def column(self, gene, state, found):
        return super().column(gene, state, found).cast("string")


class RankTransform(Transformer):
    """Share of training values up to x.

    Distinct training values and their counts are the state. Few are looked up by a step function
    in the projection; many stay a table: values are dealt to ranges, counts are summed within each
    range by a window and between ranges on the driver, so no task sorts the whole column.
    """

    name = "rank_transform"

    def fit(self, df, gene, target):
        x = finite(number(gene.inputs[0]))
        counts = df.select(x.alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        head = counts.limit(LOCAL_VALUES + 1).collect()
        if len(head) <= LOCAL_VALUES:
            return State(values={"counts": sorted((float(r.x), int(r.n)) for r in head)})
        return State(values={"counts": None}, table=counts)

    def apply(self, df, gene, state):
        x = finite(number(gene.inputs[0]))
        counts = state.values["counts"]
        if counts is not None:
            total, upto, steps = sum(n for _, n in counts), 0, []
            for value, n in counts:
                upto += n
                steps.append((value, upto / total))
            if not steps:
                return df.withColumn(gene.output, F.lit(0.5))
            values, shares = [s[0] for s in steps], [s[1] for s in steps]

            @F.pandas_udf("double")
            def rank(v):
                import numpy as np
                import pandas as pd

                at = np.searchsorted(values, v.to_numpy(float), "right") - 1
                out = np.where(at >= 0, np.asarray(shares)[np.maximum(at, 0)], 0.0)
                return pd.Series(np.where(v.isna(), 0.5, out))

            if len(values) <= 200:
                step = F.when(x.isNull(), F.lit(0.5))
                for value, share in reversed(steps):
                    step = step.when(x >= F.lit(value), F.lit(share))
                return df.withColumn(gene.output, step.otherwise(F.lit(0.0)))
            return df.withColumn(gene.output, rank(x))
        counts = state.table
        asked = df.select(x.alias("x")).where("x IS NOT NULL").distinct().withColumn("n", F.lit(0).cast("long"))
        both = counts.select("x", F.col("n").cast("long")).unionByName(asked).groupBy("x").agg(F.sum("n").alias("n"))
        total = counts.agg(F.sum("n").alias("n")).first().n
        ranks = running_totals(both, "x", ["n"]).select("x", ((F.col("n_before") + F.col("n")) / F.lit(float(total))).alias("__rank"))
        # Names of their own: the search's tables have a label __y.
        ranks = ranks.select(F.col("x").alias("__ranked"), "__rank")
        joined = df.withColumn("__asked", x).join(ranks, F.col("__asked") == F.col("__ranked"), "left")
        return joined.withColumn(gene.output, F.coalesce("__rank", F.lit(0.5))).drop("__asked", "__ranked", "__rank")


for kind in (QuantileBinning, LogBinning, QuantileBinningCat, LogBinningCat, RankTransform):
    register_transformer(kind())
