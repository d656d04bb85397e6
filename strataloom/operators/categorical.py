"""Encoders of categorical and text columns that need no label."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..registry import State, Transformer, register_transformer, text

#: Seeds of the eight minimum hashes (fixed values).
MINHASH_SEEDS = (1013, 2017, 3089, 4099, 5023, 6037, 7053, 8081)
HASH_MAX = 268435455.0


def hash28(column):
    """28 bits of an MD5, so that SQL engines agree."""
    return F.conv(F.substring(F.md5(column.cast("binary")), 1, 7), 16, 10).cast("long")


def trigrams(value):
    """All 3-character pieces of ^value$ in lower case, in order."""
    framed = F.concat(F.lit("^"), F.lower(value), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(framed) - 2, F.lit(1))), lambda i: F.substring(framed, i, F.lit(3)))


class FrequencyEncode(Transformer):
    name, input_type = "frequency_encode", "categorical"

    def key(self, gene):
        return text(gene.inputs[0])

    def grouped(self, gene, target):
        return {"n": F.count(F.lit(1)).cast("double")}

    def finish(self, gene, totals, groups, target):
        known = groups.where("key IS NOT NULL")
        return State(values={"default": known.agg(F.percentile("n", F.lit(0.5)).alias("m")).first().m or 0.0}, columns=["n"], table=known)

    def column(self, gene, state, found):
        return F.coalesce(found["n"], F.lit(float(state.values["default"])))


class OneHotEncode(Transformer):
    name, input_type = "one_hot_encode", "categorical"
    share, most = 0.05, 5

    def sample_params(self, rng, n_inputs):
        return {"comp_idx": rng.randint(1, 6)}

    def components(self, gene):
        return [1, 2, 3, 4, 5, 6]

    def key(self, gene):
        return text(gene.inputs[0])

    def grouped(self, gene, target):
        return {"n": F.count(F.lit(1))}

    def finish(self, gene, totals, groups, target):
        known = groups.where("key IS NOT NULL")
        total = known.agg(F.sum("n").alias("n")).first().n or 0
        rows = known.where(F.col("n") >= F.lit(self.share * total)).orderBy(F.desc("n"), "key").limit(self.most).collect()
        return State(values={"levels": [r.key for r in rows]})

    def column(self, gene, state, found):
        levels, k, x = state.values["levels"], int(gene.options.get("comp_idx", 1)), text(gene.inputs[0])
        if k == self.most + 1:
            return F.coalesce((~x.isin(levels)).cast("double"), F.lit(1.0)) if levels else F.lit(1.0)
        return F.coalesce((x == F.lit(levels[k - 1])).cast("double"), F.lit(0.0)) if k <= len(levels) else F.lit(0.0)


class Concat(Transformer):
    name, arity, input_type, output_type, n_inputs = "concat", "multivariate", "categorical", "categorical", (2, 3)

    def column(self, gene, state, found):
        return F.concat_ws("_", *[F.coalesce(text(c), F.lit("NA")) for c in gene.inputs])


class FeatureHash(Transformer):
    name, input_type = "feature_hash", "categorical"

    def sample_params(self, rng, n_inputs):
        bins = rng.choice([4, 8, 16, 32])
        return {"num_bins": bins, "comp_idx": rng.randint(1, bins)}

    def column(self, gene, state, found):
        bins, k = int(gene.options.get("num_bins", 8)), int(gene.options.get("comp_idx", 1))
        return (hash28(text(gene.inputs[0])) % bins + 1 == k).cast("double")


class SimilarityEncode(Transformer):
    name, input_type = "similarity_encode", "categorical"
    most = 5

    def sample_params(self, rng, n_inputs):
        return {"comp_idx": rng.randint(1, 5)}

    def components(self, gene):
        return [1, 2, 3, 4, 5]

    def key(self, gene):
        return text(gene.inputs[0])

    def grouped(self, gene, target):
        return {"n": F.count(F.lit(1))}

    def finish(self, gene, totals, groups, target):
        rows = groups.where("key IS NOT NULL AND key <> ''").orderBy(F.desc("n"), "key").limit(self.most).collect()
        return State(values={"prototypes": [r.key for r in rows]})

    def column(self, gene, state, found):
        prototypes, k, x = state.values["prototypes"], int(gene.options.get("comp_idx", 1)), text(gene.inputs[0])
        if k > len(prototypes):
            return F.lit(0.0)
        framed = f"^{prototypes[k - 1].lower()}$"
        own = F.array(*[F.lit(g) for g in sorted({framed[i : i + 3] for i in range(max(1, len(framed) - 2))})])
        grams = trigrams(x)
        score = F.size(F.array_intersect(grams, own)) / F.size(F.array_union(grams, own))
        return F.when(x.isNull() | (x == ""), F.lit(0.0)).otherwise(score)


class MinhashEncode(Transformer):
    name, input_type = "minhash_encode", "categorical"

    def sample_params(self, rng, n_inputs):
        return {"comp_idx": rng.randint(1, 8)}

    def components(self, gene):
        return list(range(1, 9))

    def column(self, gene, state, found):
        seed, x = MINHASH_SEEDS[int(gene.options.get("comp_idx", 1)) - 1], text(gene.inputs[0])
        least = F.array_min(F.transform(trigrams(x), lambda g: hash28(F.concat(g, F.lit(f"_{seed}")))))
        return F.when(x.isNull() | (x == ""), F.lit(0.0)).otherwise(least / F.lit(HASH_MAX))


class GapEncode(Transformer):
    """Projection of counts of the 30 most common 3-grams on their main directions. Grams are counted
    on distinct levels, weighted by their rows; only 30 names and a 30 x 30 matrix reach the driver."""

    name, input_type = "gap_encode", "categorical"
    vocabulary, most = 30, 4

    def sample_params(self, rng, n_inputs):
        return {"comp_idx": rng.randint(1, 4)}

    def components(self, gene):
        return [1, 2, 3, 4]

    def counts(self, x, grams):
        own = trigrams(x)

        def count(w):
            return F.coalesce(F.size(F.filter(own, lambda g: g == F.lit(w))), F.lit(0)).cast("double")

        return [count(w) for w in grams]

    def fit(self, df, gene, target):
        from ..functions.linalg import directions, weighted_gram

        x = text(gene.inputs[0])
        distinct = df.select(x.alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        known = distinct.where("x IS NOT NULL AND x <> ''")
        rows = known.select("n", F.explode(trigrams(F.col("x"))).alias("g")).groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(self.vocabulary).collect()
        grams = [r.g for r in rows]
        if not grams:
            return State(valid=False)
        # Null and empty values are zero vectors.
        columns = [F.when(F.col("x").isNull() | (F.col("x") == ""), F.lit(0.0)).otherwise(c) for c in self.counts(F.col("x"), grams)]
        total, mean, gram = weighted_gram(distinct, columns, F.col("n"))
        centred = gram - total * np.outer(mean, mean)
        return State(values={"grams": grams, "mean": mean.tolist(), "v": directions(centred, self.most)[1].tolist()})

    def column(self, gene, state, found):
        if not state.valid:
            return F.lit(0.0)
        v, x = np.array(state.values["v"]), text(gene.inputs[0])
        k = min(int(gene.options.get("comp_idx", 1)), v.shape[1]) - 1
        offset = -float(np.dot(state.values["mean"], v[:, k]))
        score = F.lit(offset)
        for c, w in zip(self.counts(x, state.values["grams"]), v[:, k].tolist(), strict=True):
            score = score + F.lit(w) * c
        return F.when(x.isNull() | (x == ""), F.lit(offset)).otherwise(score)


for kind in (FrequencyEncode, OneHotEncode, Concat, FeatureHash, SimilarityEncode, MinhashEncode, GapEncode):
    register_transformer(kind())
