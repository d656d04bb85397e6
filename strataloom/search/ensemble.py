"""Blends of recipes, by weights found on out-of-fold predictions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from random import Random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import weighted_gram
from ..functions.metrics import compute_metric
from .evaluate import evaluate_fitness
from .recipe import Recipe


@dataclass
class Ensemble:
    members: list[Recipe]
    weights: list[float]
    method: str
    fitness: float | None = None

    def predict(self, df: DataFrame, rid: str) -> DataFrame:
        """(rid, p): the weighted sum of the members' predictions."""
        used = [(m, w) for m, w in zip(self.members, self.weights, strict=True) if w > 0]
        parts = [m.predict(df, rid).withColumnRenamed("p", f"p{i}") for i, (m, _) in enumerate(used)]
        joined = reduce(lambda a, b: a.join(b, rid), parts)
        if self.members[0].task == "multiclass":
            p = F.expr(f"transform(p0, (x, k) -> {' + '.join(f'{w!r}D * p{i}[k]' for i, (_, w) in enumerate(used))})")
        else:
            p = sum((F.lit(w) * F.col(f"p{i}") for i, (_, w) in enumerate(used)), F.lit(0.0))
        return joined.select(rid, p.alias("p"))

    def transform(self, df: DataFrame) -> DataFrame:
        """All engineered columns of the members that count."""
        return reduce(lambda d, m: m.transform(d), [m for m, w in zip(self.members, self.weights, strict=True) if w > 0], df)

    def summary(self) -> str:
        rows = [f"  {w:.3f} {m.best.recipe_string}" for m, w in zip(self.members, self.weights, strict=True)]
        return "\n".join([f"Ensemble of {len(self.members)} ({self.method}), fitness {self.fitness}", *rows])


def blend(weights, names: list[str], task: str):
    """The weighted sum of columns of predictions, by class for multiclass tasks."""
    used = [(float(w), n) for w, n in zip(weights, names, strict=True) if w]
    if task == "multiclass":
        return F.expr(f"transform(`{used[0][1]}`, (x, k) -> {' + '.join(f'{w!r}D * `{n}`[k]' for w, n in used)})")
    return sum((F.lit(w) * F.col(n) for w, n in used), F.lit(0.0))


def caruana_select(table: DataFrame, names: list[str], task: str, metric, n_classes: int, rounds: int = 50, patience: int = 15, bags: int = 0, sample_ratio: float = 0.8, seed: int = 0) -> list[float]:
    """Greedy forward selection with replacement, from the best single member. ``table`` has y and a
    column of predictions per name, arrays by class for multiclass tasks. Squared errors follow from
    one Gram matrix; other metrics score each candidate blend in Spark."""
    rng, k = Random(seed), len(names)
    square = task == "regression" and metric in ("default", "rmse")
    gram = weighted_gram(table, [F.col("y"), *[F.col(n) for n in names]]) if square else None

    def score(w: np.ndarray) -> float:
        if square:
            v = np.concatenate([[1.0], -w])
            return -float(np.sqrt(max(0.0, v @ gram[2] @ v / gram[0])))
        return compute_metric(table.select("y", blend(w, names, task).alias("p")), task, metric, n_classes)

    def once(pool: list[int]) -> np.ndarray:
        singles = {i: score(np.eye(k)[i]) for i in pool}
        picked = [max(pool, key=lambda i: singles[i])]
        best, best_at, waited = singles[picked[0]], 1, 0
        for _ in range(rounds - 1):
            trial = {i: score((np.bincount(picked, minlength=k) + np.eye(k)[i]) / (len(picked) + 1)) for i in pool}
            i = max(pool, key=lambda c: trial[c])
            picked.append(i)
            if trial[i] > best + 1e-7:
                best, best_at, waited = trial[i], len(picked), 0
            else:
                waited += 1
                if waited >= patience:
                    break
        return np.bincount(picked[:best_at], minlength=k) / best_at

    if not bags:
        return once(list(range(k))).tolist()
    pools = [rng.sample(range(k), max(1, round(sample_ratio * k))) for _ in range(bags)]
    return np.mean([once(p) for p in pools], axis=0).tolist()


def stack_weights(table: DataFrame, names: list[str], strength: float = 1e-3, alpha: float = 0.5, rounds: int = 500) -> list[float]:
    """Non-negative elastic net of the label on the predictions by coordinate descent on their Gram matrix; weights sum to 1."""
    n, _, g = weighted_gram(table, [F.col("y"), *[F.col(c) for c in names]])
    a, b, w = g[1:, 1:] / n, g[1:, 0] / n, np.zeros(len(names))
    for _ in range(rounds):
        for j in range(len(w)):
            rest = b[j] - a[j] @ w + a[j, j] * w[j]
            w[j] = max(0.0, rest - strength * alpha) / (a[j, j] + strength * (1 - alpha) + 1e-12)
    return (w / w.sum()).tolist() if w.sum() > 0 else [1 / len(names)] * len(names)


def stacking_rows(table: DataFrame, names: list[str], task: str) -> DataFrame:
    """(y, a number per name): each class of each row is a row, as blends are the same for all classes."""
    if task != "multiclass":
        return table
    entries = table.select("y", F.posexplode(names[0]).alias("k", "__first"), *[F.col(n) for n in names])
    return entries.select((F.col("y") == F.col("k")).cast("double").alias("y"), *[F.element_at(n, F.col("k") + 1).alias(n) for n in names])


def stack_select(table: DataFrame, names: list[str], task: str, problem, alpha: float, folds: int = 3) -> tuple[list[float], float]:
    """(weights from all rows, an honest fitness): for the latter each fold of rows, by hash of the
    row id, is predicted with the weights that the other folds give."""
    fold = F.pmod(F.xxhash64(F.col(problem.rid)), F.lit(folds))
    parts = []
    for k in range(folds):
        weights = stack_weights(stacking_rows(table.where(fold != k), names, task), names, alpha=alpha)
        parts.append(table.where(fold == k).select("y", blend(weights, names, task).alias("p")))
    fitness = compute_metric(reduce(DataFrame.unionByName, parts), task, problem.metric, problem.n_classes)
    return stack_weights(stacking_rows(table, names, task), names, alpha=alpha), fitness


def ensemble_islands(recipes: list[Recipe], method: str = "caruana", rounds: int = 50, bags: int = 0, sample_ratio: float = 0.8, alpha: float = 0.5, seed: int = 0) -> Ensemble:
    """Blend recipes of one problem. Their out-of-fold predictions come from common folds and are
    joined by row id. Aliases of ``equal``: uniform, average."""
    method = {"uniform": "equal", "average": "equal"}.get(method, method)
    if method not in ("caruana", "stack", "equal"):
        raise ValueError(f"unknown method {method!r}")
    first = recipes[0]
    problem = first.problem
    if method == "equal" or len(recipes) == 1:
        return Ensemble(recipes, [1 / len(recipes)] * len(recipes), method)
    tables = [evaluate_fitness(r.best.copy(), problem, keep=True).oof for r in recipes]
    names = [f"p{i}" for i in range(len(recipes))]
    joined = tables[0].withColumnRenamed("p", "p0")
    for i, t in enumerate(tables[1:], 1):
        joined = joined.join(t.select(problem.rid, F.col("p").alias(f"p{i}")), problem.rid)
    joined = joined.persist()
    try:
        if method == "stack":
            weights, fitness = stack_select(joined, names, first.task, problem, alpha)
        else:
            weights = caruana_select(joined, names, first.task, problem.metric, problem.n_classes, rounds, bags=bags, sample_ratio=sample_ratio, seed=seed)
            fitness = compute_metric(joined.select("y", blend(weights, names, first.task).alias("p")), first.task, problem.metric, problem.n_classes)
        return Ensemble(recipes, weights, method, fitness)
    finally:
        joined.unpersist()
