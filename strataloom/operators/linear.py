"""Projections: principal components, singular vectors, correspondence analysis and their supervised kin.

Fits collect one Gram matrix; a fitted projection is a sum of columns, and of looked-up coefficients
for categorical inputs, in one projection.
"""

from __future__ import annotations

from random import Random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import centred_gram, components_of, directions, linear, weighted_gram
from ..registry import State, Target, Transformer, number, register_transformer, text
from ..roles import finite

#: Levels of the categorical inputs together that a Gram matrix is built for; it has their square in entries.
MAX_LEVELS = 2000


class Projection(Transformer):
    arity, n_inputs = "multivariate", (2, 5)

    def sample_params(self, rng, n_inputs):
        return {"comp_idx": rng.randint(1, components_of(n_inputs))}

    def components(self, gene):
        return list(range(1, components_of(len(gene.inputs)) + 1))

    def pick(self, gene, v: np.ndarray) -> np.ndarray:
        """The component asked for, or the last."""
        return v[:, min(int(gene.options.get("comp_idx", 1)), v.shape[1]) - 1]


def zero_filled(gene) -> list[Column]:
    return [F.coalesce(finite(number(c)), F.lit(0.0)) for c in gene.inputs]


class Pca(Projection):
    name = "pca"

    def fit(self, df, gene, target):
        n, mean, gram = centred_gram(df, zero_filled(gene))
        cov = gram / max(n - 1, 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        if n < 2 or (sd < 1e-12 * np.maximum(1, np.abs(mean))).any():
            return State(valid=False)
        v = directions(cov / np.outer(sd, sd), components_of(len(mean)))[1]
        return State(values={"mean": mean.tolist(), "sd": sd.tolist(), "v": v.tolist()})

    def column(self, gene, state, found):
        if not state.valid:
            return F.lit(0.0)
        z = [(c - F.lit(m)) / F.lit(s) for c, m, s in zip(zero_filled(gene), state.values["mean"], state.values["sd"], strict=True)]
        return linear(z, self.pick(gene, np.array(state.values["v"])))


class TruncatedSvd(Projection):
    name = "truncated_svd"

    def fit(self, df, gene, target):
        n, _, gram = weighted_gram(df, zero_filled(gene))
        return State(values={"v": directions(gram, components_of(len(gram)))[1].tolist()}, valid=n > 0)

    def column(self, gene, state, found):
        return linear(zero_filled(gene), self.pick(gene, np.array(state.values["v"]))) if state.valid else F.lit(0.0)


class RandomProjection(Projection):
    name = "random_projection"

    def sample_params(self, rng, n_inputs):
        return {"seed": rng.randint(0, 2**31 - 1)}

    def components(self, gene):
        return []

    def fit(self, df, gene, target):
        rng = Random(int(gene.options.get("seed", 0)))
        return State(values={"w": [rng.gauss(0, 1) for _ in gene.inputs]})

    def column(self, gene, state, found):
        return linear(zero_filled(gene), state.values["w"])


def label_group(target: Target, df: DataFrame) -> Column:
    """Quarter of a numeric label with more than ten values, else the label as text; null is "NA"."""
    c = F.col(f"`{target.column}`")
    if target.kind == "numeric" and not 0 < len(target.levels) <= 10:
        cuts = sorted(set(df.agg(F.percentile(c.cast("double"), F.array(*[F.lit(i / 4) for i in range(5)])).alias("q")).first().q))
        if len(cuts) < 2:
            return F.lit("q1")
        group = F.lit("q1")
        for i, cut in enumerate(cuts[1:-1], 2):
            group = F.when(c > F.lit(cut), F.lit(f"q{i}")).otherwise(group)
        return F.when(c.isNull(), F.lit("NA")).otherwise(group)
    return F.coalesce(c.cast("string"), F.lit("NA"))


class Mixed(Projection):
    """Numeric inputs as z-scores and categorical ones as weighted indicators, in one matrix.

    Sums and products of numeric inputs, of levels and between the two all come from aggregates:
    products of two indicators are counts of pairs of levels, so the indicators are never made.
    With groups, each row counts as its group's mean, and the matrix is the sum over groups of
    size times mean times mean'.
    """

    input_type = "mixed"
    supervised = False
    scale_by = "p"  # indicators over the root of their share, or of their count

    def split(self, gene, df: DataFrame) -> tuple[list[str], list[str]]:
        kinds = dict(df.dtypes)
        numeric = [c for c in gene.inputs if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")]
        return numeric, [c for c in gene.inputs if c not in numeric]

    def components(self, gene):
        return [1, 2]

    def sample_params(self, rng, n_inputs):
        return {"comp_idx": rng.randint(1, 2)}

    def matrix(self, df: DataFrame, z: list[Column], cats: list[str], group: Column | None):
        """(rows, levels by input, level counts, Gram of [z, indicators] centred by the share of each level)."""
        q, n = len(z), None
        base = df.select(*[c.alias(f"z{i}") for i, c in enumerate(z)], *[text(c).alias(f"c{i}") for i, c in enumerate(cats)], *([group.alias("g")] if group is not None else []))
        n = float(base.count())
        counts = {}
        for i in range(len(cats)):
            counts[i] = {r[0]: float(r[1]) for r in base.where(F.col(f"c{i}").isNotNull()).groupBy(f"c{i}").count().orderBy(F.desc("count"), f"c{i}").limit(MAX_LEVELS + 1).collect()}
        if sum(map(len, counts.values())) > MAX_LEVELS or not n:
            return None
        levels = {i: sorted(counts[i]) for i in counts}
        place = {(i, v): q + k for k, (i, v) in enumerate((i, v) for i in levels for v in levels[i])}
        size = q + len(place)
        share = np.zeros(size)
        for (i, v), k in place.items():
            share[k] = counts[i][v] / n
        if group is None:
            gram = np.zeros((size, size))
            if q:
                gram[:q, :q] = weighted_gram(base, [F.col(f"z{i}") for i in range(q)])[2]
            for i in range(len(cats)):
                for r in base.where(F.col(f"c{i}").isNotNull()).groupBy(f"c{i}").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"z{k}").alias(f"s{k}") for k in range(q)]).collect():
                    at = place[i, r[0]]
                    gram[at, at] = r.n
                    for k in range(q):
                        gram[at, k] = gram[k, at] = r[f"s{k}"] or 0.0
                for j in range(i):
                    for r in base.where(F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull()).groupBy(f"c{i}", f"c{j}").count().collect():
                        a, b = place[i, r[0]], place[j, r[1]]
                        gram[a, b] = gram[b, a] = r[2]
            sums = np.array([n * share[k] if k >= q else 0.0 for k in range(size)])
            zsum = base.agg(*[F.sum(f"z{k}").alias(f"s{k}") for k in range(q)]).first() if q else []
            sums[:q] = [x or 0.0 for x in zsum]
            gram = gram - np.outer(sums, share) - np.outer(share, sums) + n * np.outer(share, share)
        else:
            groups = {r[0]: r for r in base.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"z{k}").alias(f"m{k}") for k in range(q)]).collect()}
            means = {g: np.concatenate([[r[f"m{k}"] or 0.0 for k in range(q)], np.zeros(len(place))]) for g, r in groups.items()}
            for i in range(len(cats)):
                for r in base.where(F.col(f"c{i}").isNotNull()).groupBy("g", f"c{i}").count().collect():
                    means[r[0]][place[i, r[1]]] = r[2] / groups[r[0]].n
            gram = sum(groups[g].n * np.outer(m - share, m - share) for g, m in means.items())
        return n, levels, share, gram

    def standard(self, df, numeric):
        """(z-scores with nulls as means, means, deviations) over the training rows."""
        if not numeric:
            return [], [], []
        x = [finite(number(c)) for c in numeric]
        r = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
        mean, sd = [r[f"m{i}"] or 0.0 for i in range(len(x))], [r[f"s{i}"] or 1.0 for i in range(len(x))]
        return self.scores(numeric, mean, sd), mean, sd

    def scores(self, numeric, mean, sd):
        return [(F.coalesce(finite(number(c)), F.lit(m)) - F.lit(m)) / F.lit(s) for c, m, s in zip(numeric, mean, sd, strict=True)]

    def fit(self, df, gene, target):
        numeric, cats = self.split(gene, df)
        group = self.group(gene, target, df)
        if group is None and self.supervised:
            return State(valid=False)
        numeric, cats = self.used(numeric, cats, gene)
        z, mean, sd = self.standard(df, numeric)
        made = self.matrix(df, z, cats, group)
        if made is None or not len(made[3]):
            return State(valid=False)
        n, levels, share, gram = made
        q = len(numeric)
        weight = np.concatenate([np.ones(q), 1 / np.sqrt(share[q:] * (n if self.scale_by == "n" else 1))])
        v = directions(gram * np.outer(weight, weight), self.retained(len(gram), len(cats)))[1] * weight[:, None]
        names = {(i, x): q + k for k, (i, x) in enumerate((i, x) for i in levels for x in levels[i])}
        factor = 1 / np.sqrt(len(cats)) if self.scale_by == "n" and cats else 1.0
        return State(values={"numeric": numeric, "cats": cats, "mean": mean, "sd": sd, "v": (v * factor).tolist(), "levels": [[i, x, k] for (i, x), k in names.items()], "share": share.tolist()})

    def used(self, numeric, cats, gene):
        return numeric, cats

    def retained(self, size, n_cats):
        return min(components_of(size), size)

    def group(self, gene, target, df):
        return label_group(target, df) if self.supervised and target is not None else None

    def column(self, gene, state, found):
        if not state.valid:
            return F.lit(0.0)
        s = state.values
        w = self.pick(gene, np.array(s["v"]))
        score = linear(self.scores(s["numeric"], s["mean"], s["sd"]), w[: len(s["numeric"])]) - F.lit(float(np.dot(w[len(s["numeric"]) :], s["share"][len(s["numeric"]) :])))
        for i, c in enumerate(s["cats"]):
            entries = [x for name in ((F.lit(x), F.lit(float(w[k]))) for j, x, k in s["levels"] if j == i) for x in name]
            if entries:
                score = score + F.coalesce(F.try_element_at(F.create_map(*entries), text(c)), F.lit(0.0))
        return score


class Mca(Mixed):
    name, input_type, scale_by = "mca", "categorical", "n"

    def used(self, numeric, cats, gene):
        return [], list(gene.inputs)

    def retained(self, size, n_cats):
        return min(max(2, min(components_of(size), size - n_cats)), size)


class Famd(Mixed):
    name = "famd"


class SupervisedMca(Mca):
    name, supervised, needs_target = "supervised_mca", True, True


class SupervisedFamd(Famd):
    name, supervised, needs_target = "supervised_famd", True, True


class BetweenGroupPca(Mixed):
    """Directions between the means of the first input's groups; the first input itself isn't projected."""

    name, arity, n_inputs = "between_group_pca", "multivariate", (3, 5)

    def used(self, numeric, cats, gene):
        return list(gene.inputs[1:]), []

    def group(self, gene, target, df):
        return F.coalesce(text(gene.inputs[0]), F.lit("NA"))


class SupervisedBgpca(Mixed):
    name, input_type, supervised, needs_target = "supervised_bgpca", "numeric", True, True

    def used(self, numeric, cats, gene):
        return list(gene.inputs), []


for kind in (Pca, TruncatedSvd, RandomProjection, Mca, Famd, BetweenGroupPca, SupervisedBgpca, SupervisedMca, SupervisedFamd):
    register_transformer(kind())
