"""Stateless arithmetic columns."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import functions as F

from ..registry import Transformer, fill, number, register_transformer


class Log(Transformer):
    name = "log"

    def column(self, gene, state, found):
        return F.log1p(F.abs(number(gene.inputs[0])))


class Sqrt(Transformer):
    name = "sqrt"

    def column(self, gene, state, found):
        return F.sqrt(F.abs(number(gene.inputs[0])))


class Reciprocal(Transformer):
    name = "reciprocal"

    def column(self, gene, state, found):
        x = number(gene.inputs[0])
        return F.when(x == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), x))


class Fold(Transformer):
    """A left fold over two to five columns, which may repeat."""

    arity, allow_replace, n_inputs = "multivariate", True, (2, 5)

    def column(self, gene, state, found):
        return reduce(self.step, map(number, gene.inputs))


class Add(Fold):
    name, step = "add", staticmethod(operator.add)


class Multiply(Fold):
    name, step = "multiply", staticmethod(operator.mul)


class Binary(Transformer):
    arity, n_inputs = "binary", (2, 2)

    def pair(self, gene):
        return number(gene.inputs[0]), number(gene.inputs[1])


class Subtract(Binary):
    name = "subtract"

    def column(self, gene, state, found):
        a, b = self.pair(gene)
        return a - b


class Divide(Binary):
    name = "divide"

    def column(self, gene, state, found):
        a, b = self.pair(gene)
        return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


class NormalizedDifference(Binary):
    name = "normalized_difference"

    def column(self, gene, state, found):
        a, b = self.pair(gene)
        return fill((a - b) / (F.abs(a) + F.abs(b) + F.lit(1e-8)), 0.0)


class LogRatio(Binary):
    name = "log_ratio"

    def column(self, gene, state, found):
        a, b = self.pair(gene)
        return F.log1p(F.abs(a)) - F.log1p(F.abs(b))


class Power(Transformer):
    name = "power"

    def sample_params(self, rng, n_inputs):
        return {"p": rng.choice([0.5, 1 / 3, 2.0, 3.0])}

    def column(self, gene, state, found):
        x = number(gene.inputs[0])
        return fill(F.signum(x) * F.pow(F.abs(x), F.lit(float(gene.options.get("p", 2)))), 0.0)


class DisplacedLog(Transformer):
    name = "displaced_log"

    def sample_params(self, rng, n_inputs):
        return {"displacement": round(rng.uniform(10, 1000), 2)}

    def column(self, gene, state, found):
        return fill(F.log1p(F.abs(number(gene.inputs[0]) + F.lit(float(gene.options.get("displacement", 100))))), 0.0)


for kind in (Log, Sqrt, Reciprocal, Add, Subtract, Multiply, Divide, NormalizedDifference, LogRatio, Power, DisplacedLog):
    register_transformer(kind())
