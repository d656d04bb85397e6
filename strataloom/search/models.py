"""Models on a table of features: built on Spark's own, behind one interface."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import EVALUATORS, register_evaluator
from ..roles import finite

#: Levels of a categorical feature that get codes of their own; the others share HASH_CODES more by hash.
MAX_CODES, HASH_CODES = 1000, 64


@dataclass
class Matrix:
    """Features as one vector: numbers with training means for what is missing, and codes of training levels."""

    means: dict[str, float] = field(default_factory=dict)
    codes: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def fit(df: DataFrame, features: list[str]) -> Matrix:
        kinds = dict(df.dtypes)
        text = [c for c in features if kinds[c] in ("string", "boolean", "timestamp", "timestamp_ntz", "date")]
        numbers = [c for c in features if c not in text]
        row = df.agg(F.count(F.lit(1)), *[F.avg(finite(F.col(f"`{c}`").cast("double"))).alias(f"m{i}") for i, c in enumerate(numbers)]).first()
        codes = {}
        for c in text:
            counts = df.groupBy(F.col(f"`{c}`").cast("string").alias("v")).count().where("v IS NOT NULL")
            codes[c] = sorted(r.v for r in counts.orderBy(F.desc("count"), "v").limit(MAX_CODES).collect())
        return Matrix({c: row[f"m{i}"] or 0.0 for i, c in enumerate(numbers)}, codes)

    def columns(self) -> list[Column]:
        out = [F.coalesce(finite(F.col(f"`{c}`").cast("double")), F.lit(m)) for c, m in self.means.items()]
        for c, levels in self.codes.items():
            entries = [x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(float(i + 1)))]
            x = F.col(f"`{c}`").cast("string")
            other = F.when(x.isNotNull(), F.pmod(F.xxhash64(x), F.lit(HASH_CODES)).cast("double") + F.lit(float(len(levels) + 1))) if len(levels) >= MAX_CODES else F.lit(None)
            out.append(F.coalesce(F.try_element_at(F.create_map(*entries), x), other, F.lit(0.0)) if entries else F.lit(0.0))
        return out

    @property
    def names(self) -> list[str]:
        return [*self.means, *self.codes]

    def vectors(self, df: DataFrame, *keep: Column) -> DataFrame:
        named = df.select(*keep, *[c.alias(f"__x{i}") for i, c in enumerate(self.columns())])
        return VectorAssembler(inputCols=[f"__x{i}" for i in range(len(self.names))], outputCol="__features", handleInvalid="keep").transform(named)


@dataclass
class Fitted:
    matrix: Matrix
    model: object
    task: str
    n_classes: int
    importances: dict[str, float] = field(default_factory=dict)

    def predict(self, df: DataFrame, *keep: Column) -> DataFrame:
        """The ``keep`` columns and ``p``: a number, or an array of class probabilities for multiclass tasks."""
        out = self.model.transform(self.matrix.vectors(df, *keep))
        if self.task == "regression":
            p = F.col("prediction")
        elif "probability" in out.columns:
            p = vector_to_array("probability")
        else:  # one against the rest: raw scores as a softmax
            raw = vector_to_array("rawPrediction")
            e = F.transform(raw, lambda x: F.exp(x))
            p = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
        if self.task == "classification":
            p = F.element_at(p, 2)
        return out.select(*df.select(*keep).columns, p.alias("p"))


class Evaluator:
    """A model family; ``build`` gives the Spark estimator."""

    name = ""

    def build(self, task: str, n_classes: int, params: dict):
        raise NotImplementedError

    def fit(self, df: DataFrame, features: list[str], label: str, task: str, n_classes: int = 2, **params) -> Fitted:
        matrix = Matrix.fit(df, features)
        data = matrix.vectors(df.where(F.col(f"`{label}`").isNotNull()), F.col(f"`{label}`").cast("double").alias("label")).persist()
        try:
            model = self.train(data, task, n_classes, params)
            return Fitted(matrix, model, task, n_classes, self.importances(model, matrix, data))
        finally:
            data.unpersist()

    def train(self, data: DataFrame, task: str, n_classes: int, params: dict):
        """The Spark model of (__features, label)."""
        return self.build(task, n_classes, params).setFeaturesCol("__features").setLabelCol("label").fit(data)

    def importances(self, model, matrix: Matrix, data: DataFrame) -> dict[str, float]:
        """By feature: a model's own, the sum of those of its one-against-rest models, or, of a
        perceptron, the products of absolute weights along all paths times the inputs' deviations."""
        parts = getattr(model, "models", [model])
        if all(hasattr(m, "featureImportances") for m in parts):
            return dict(zip(matrix.names, sum(m.featureImportances.toArray() for m in parts).tolist(), strict=True))
        if hasattr(model, "weights") and hasattr(model, "getLayers"):
            sizes, flat, at = model.getLayers(), model.weights.toArray(), 0
            reach = None
            for a, b in zip(sizes, sizes[1:], strict=False):
                w = np.abs(flat[at : at + a * b].reshape(b, a).T)
                reach, at = w if reach is None else reach @ w, at + (a + 1) * b
            return dict(zip(matrix.names, (reach.sum(axis=1) * deviations(data)).tolist(), strict=True))
        return {}


def deviations(data: DataFrame) -> np.ndarray:
    return data.select(Summarizer.metrics("std").summary(F.col("__features")).alias("s")).first().s.std.toArray()


def fold_grams(data: DataFrame, n_classes: int, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, Gram of [1, features, labels]) of each fold by hash of the rows; a class label is a column
    for each class but one. Tasks add up their batches, and a row an entry and task is shuffled."""
    labels = max(1, n_classes - 1)
    vectors = data.select(vector_to_array("__features").alias("x"), "label", F.pmod(F.xxhash64("__features", "label"), F.lit(folds)).cast("int").alias("fold"))

    def add(batches):
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            y = b.column("label").to_numpy()
            y = y[:, None] if n_classes <= 2 else (y[:, None] == np.arange(1, n_classes)).astype(float)
            rows, fold = np.column_stack([np.ones(len(x)), x, y]), b.column("fold").to_numpy()
            total = np.zeros((folds, rows.shape[1], rows.shape[1])) if total is None else total
            for k in range(folds):
                part = rows[fold == k]
                total[k] += part.T @ part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    found = vectors.mapInArrow(add, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
    values = found.column("v").to_numpy()
    p = round((len(values) / folds) ** 0.5) if len(values) else labels + 1
    gram = values.reshape(folds, p, p) if len(values) else np.zeros((folds, p, p))
    return gram[:, 0, 0], gram


def elastic_net(gram: np.ndarray, cross: np.ndarray, strength: float, alpha: float, start: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Coordinate descent on correlations: ``gram`` of the inputs, ``cross`` with the label."""
    w = start.copy()
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            rest = cross[j] - gram[j] @ w + gram[j, j] * w[j]
            w[j] = np.sign(rest) * max(0.0, abs(rest) - strength * alpha) / (gram[j, j] + strength * (1 - alpha) + 1e-12)
        if np.abs(w - before).max(initial=0) < 1e-7:
            break
    return w


def chosen_strength(grams: np.ndarray, labels: int, alpha: float, path: int = 20) -> float:
    """The strength of the path, from the least one that leaves no weight down to a thousandth of it,
    with the least squared error on the folds left out; in units of the label's deviation."""
    whole = grams.sum(axis=0)

    def scaled(g):
        n = max(g[0, 0], 1.0)
        mean = g[0] / n
        cov = g / n - np.outer(mean, mean)
        return mean, cov

    p = whole.shape[0] - labels
    _, cov = scaled(whole)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    top = max(float(np.abs(cov[1:p, p:] / np.outer(sd[1:p], sd[p:])).max(initial=0)) / max(alpha, 1e-3), 1e-6)
    strengths = np.geomspace(top, top / 1000, path)
    error = np.zeros(path)
    for left in grams:
        if not left[0, 0] or whole[0, 0] - left[0, 0] < 3:
            continue
        mean, cov = scaled(whole - left)
        a = cov[1:p, 1:p] / np.outer(sd[1:p], sd[1:p])
        for y in range(p, whole.shape[0]):
            w = np.zeros(p - 1)
            for k, s in enumerate(strengths):
                w = elastic_net(a, cov[1:p, y] / (sd[1:p] * sd[y]), s, alpha, w)
                beta = np.zeros(whole.shape[0])
                beta[1:p], beta[y] = -w * sd[y] / sd[1:p], 1.0
                beta[0] = -(mean[1:] @ beta[1:])
                error[k] += beta @ left @ beta / sd[y] ** 2
    return float(strengths[int(np.argmin(error))])


class Linear(Evaluator):
    """Elastic net, half lasso and half ridge; importances are coefficients times deviations.

    Unless ``lambda`` is given, the strength is chosen by cross-validation over a path of them. All
    folds come from one aggregate of products, on which the path is solved; for classes the squared
    error of their indicators decides.
    """

    name, folds = "lm", 5

    def train(self, data, task, n_classes, params):
        if "lambda" not in params:
            alpha, labels = params.get("alpha", 0.5), max(1, n_classes - 1) if task != "regression" else 1
            rows, grams = fold_grams(data, n_classes if task != "regression" else 2, self.folds)
            strength = chosen_strength(grams, labels, alpha) if rows.sum() > 0 else 1e-3
            whole, n = grams.sum(axis=0), max(float(rows.sum()), 1.0)
            spread = np.sqrt(np.maximum(np.diag(whole)[-labels:] / n - (whole[0, -labels:] / n) ** 2, 1e-12)).max()
            params = {**params, "lambda": strength * float(spread)}
        return super().train(data, task, n_classes, params)

    def build(self, task, n_classes, params):
        options = {"elasticNetParam": params.get("alpha", 0.5), "regParam": params.get("lambda", 1e-3), "maxIter": int(params.get("nrounds", 50))}
        return LinearRegression(**options) if task == "regression" else LogisticRegression(**options, family="multinomial" if task == "multiclass" else "binomial")

    def importances(self, model, matrix, data):
        sd = deviations(data)
        weights = np.abs(model.coefficientMatrix.toArray()).sum(axis=0) if hasattr(model, "coefficientMatrix") else np.abs(model.coefficients.toArray())
        return dict(zip(matrix.names, (weights * sd).tolist(), strict=True))


class Boosted(Evaluator):
    """Gradient-boosted trees; multiclass tasks one against the rest. A tenth of the rows, by hash, tells
    when more trees don't help. ``metric`` mae or cal_mae fits absolute errors."""

    def __init__(self, name: str, depth: int):
        self.name, self.depth = name, depth

    def build(self, task, n_classes, params):
        options = {"maxIter": int(params.get("nrounds", 50)), "validationIndicatorCol": "__check", "validationTol": 0.001, "stepSize": params.get("learning_rate", 0.1), "maxDepth": int(params.get("max_depth", self.depth)), "subsamplingRate": params.get("subsample", 1.0), "seed": 1, "maxBins": 64}
        if task == "regression":
            return GBTRegressor(**options, lossType="absolute" if params.get("metric") in ("mae", "cal_mae") else "squared")
        one = GBTClassifier(**options)
        return one if task == "classification" else OneVsRest(classifier=one)


    def train(self, data, task, n_classes, params):
        checked = data.withColumn("__check", F.pmod(F.xxhash64("__features", "label"), F.lit(10)) == 0)
        kinds = checked.groupBy("__check").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("c")).collect()
        # Every class has to be on both sides; else no row is kept back.
        enough = len(kinds) == 2 and (task == "regression" or len({r.c for r in kinds}) == 1)
        estimator = self.build(task, n_classes, params)
        if not enough or task == "multiclass":  # one against the rest passes no indicator on
            for e in (estimator, *([estimator.getClassifier()] if hasattr(estimator, "getClassifier") else [])):
                if e.hasParam("validationIndicatorCol"):
                    e.clear(e.validationIndicatorCol)
        return estimator.setFeaturesCol("__features").setLabelCol("label").fit(checked if enough else data)


class Forest(Evaluator):
    name = "rf"

    def build(self, task, n_classes, params):
        options = {"numTrees": int(params.get("nrounds", 50)), "maxDepth": int(params.get("max_depth", 8)), "seed": 1, "maxBins": 64}
        return RandomForestRegressor(**options) if task == "regression" else RandomForestClassifier(**options)


class Binned:
    """A classifier over ``BINS`` ranges of a numeric label; it predicts the expected mean of a range."""

    def __init__(self, model, means: list[float]):
        self.model, self.means = model, means

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        p = vector_to_array("probability")
        expected = sum((F.get(p, i) * F.lit(m) for i, m in enumerate(self.means)), F.lit(0.0))
        return out.withColumn("prediction", expected).drop("probability", "rawPrediction")

    @property
    def weights(self):
        return self.model.weights

    def getLayers(self):  # noqa: N802  as Spark's models have it
        return self.model.getLayers()


#: Ranges of a numeric label that a perceptron tells apart.
BINS = 16


class Perceptron(Evaluator):
    """A multilayer perceptron for classes; a numeric label is cut into ranges of equal counts, which
    are its classes, and predicted as the expectation over their means."""

    def __init__(self, name: str, layers: tuple[int, ...]):
        self.name, self.layers = name, layers

    def fit(self, df, features, label, task, n_classes=2, **params):
        self.width = len(features)
        return super().fit(df, features, label, task, n_classes, **params)

    def build(self, task, n_classes, params):
        return MultilayerPerceptronClassifier(layers=[self.width, *self.layers, max(2, n_classes)], maxIter=int(params.get("nrounds", 60)), seed=1)

    def train(self, data, task, n_classes, params):
        if task != "regression":
            return super().train(data, task, n_classes, params)
        cuts = sorted(set(data.agg(F.percentile_approx("label", F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), 20 * BINS).alias("q")).first().q or []))
        place = sum(((F.col("label") > F.lit(c)).cast("double") for c in cuts), F.lit(0.0))
        binned = data.withColumn("__bin", place)
        means = {int(r["__bin"]): r.m for r in binned.groupBy("__bin").agg(F.avg("label").alias("m")).collect()}
        fitted = self.build(task, len(cuts) + 1, params).setFeaturesCol("__features").setLabelCol("__bin").fit(binned)
        return Binned(fitted, [means.get(i, cuts[min(i, len(cuts) - 1)] if cuts else 0.0) for i in range(max(2, len(cuts) + 1))])


for evaluator in (Linear(), Boosted("lightgbm", 4), Boosted("xgboost", 6), Boosted("catboost", 6), Forest(), Perceptron("keras3", (64, 64)), Perceptron("realmlp", (256, 256, 256))):
    if evaluator.name not in EVALUATORS:
        register_evaluator(evaluator.name, evaluator)
