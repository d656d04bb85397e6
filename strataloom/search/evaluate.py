"""Fitness of an individual: its recipe fitted on training rows, a model, and a metric on held-out rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import complexity_penalty, compute_metric, normalised_importances, penalised
from ..gene import Individual
from ..plans.pipeline import apply_fitted, fit_apply
from ..registry import EVALUATORS, State, Target
from . import models


#: What a recipe that can't be fitted raises; a lost executor or a bug is none of these.
EXPECTED = (ValueError, ArithmeticError, np.linalg.LinAlgError, IllegalArgumentException)


@dataclass
class Problem:
    """Data and rules that every evaluation shares. ``data`` has the row id, the label as a number in
    ``__y``, and ``fold`` (cross-validation) or ``part`` (train, val, holdout). ``scored`` keeps what
    was evaluated on these rows, by recipe and folds."""

    data: DataFrame
    rid: str
    target: Target
    task: str
    metric: str | Callable = "default"
    evaluator: str = "lm"
    n_classes: int = 2
    folds: list[int] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    penalty: dict = field(default_factory=dict)
    redundancy: bool = True
    scored: dict[tuple, Individual] = field(default_factory=dict)

    def parts(self, folds: list[int] | None = None) -> list[tuple[DataFrame, DataFrame]]:
        """(train, validation) of each fold, or of the split."""
        if self.folds:
            return [(self.data.where(F.col("fold") != f), self.data.where(F.col("fold") == f)) for f in (folds or self.folds)]
        return [(self.data.where("part = 'train'"), self.data.where("part = 'val'"))]

    def model(self):
        if self.evaluator not in EVALUATORS:
            raise ValueError(f"unknown evaluator {self.evaluator!r}; known: {', '.join(sorted(EVALUATORS))}")
        return EVALUATORS[self.evaluator]


def label_column(target: Target, task: str) -> Column:
    c = F.col(f"`{target.column}`")
    if task == "regression":
        return c.cast("double")
    entries = [x for i, v in enumerate(target.levels) for x in (F.lit(v), F.lit(float(i)))]
    return F.try_element_at(F.create_map(*entries), c)


@dataclass
class FoldResult:
    score: float
    fitted: models.Fitted
    states: dict[str, State]
    individual: Individual
    predictions: DataFrame


def evaluate_part(individual: Individual, problem: Problem, train: DataFrame, val: DataFrame) -> FoldResult:
    train, (val,), done, states = fit_apply(individual, train, problem.target, [val], redundancy=problem.redundancy)
    fitted = problem.model().fit(train, done.features, "__y", problem.task, problem.n_classes, **problem.params)
    predictions = fitted.predict(val, F.col(problem.rid), F.col("__y").alias("y"))
    return FoldResult(compute_metric(predictions, problem.task, problem.metric, problem.n_classes), fitted, states, done, predictions)


def evaluate_fitness(individual: Individual, problem: Problem, best: float | None = None, baseline: float | None = None, n_samples: int | None = None, folds: list[int] | None = None, keep: bool = False) -> Individual:
    """A scored copy: mean over the folds that worked, less the complexity penalty; -inf if none did."""
    results, errors = [], []
    for train, val in problem.parts(folds):
        try:
            results.append(evaluate_part(individual, problem, train, val))
        except EXPECTED as e:  # a recipe that can't be fitted on a fold is skipped there
            errors.append(e)
    out = individual.copy(n_folds_ok=len(results))
    if not results:
        out.fitness = out.raw_fitness = -math.inf
        out.errors = errors
        return out
    out.raw_fitness = sum(r.score for r in results) / len(results)
    out.importances = normalised_importances([r.fitted.importances for r in results])
    out.penalty = complexity_penalty(len(individual.genes), n_samples or 0, best, baseline, problem.task, n_features=len(individual.features), **problem.penalty)
    out.fitness = penalised(out.raw_fitness, out.penalty, problem.task)
    if keep:
        oof = results[0].predictions
        for r in results[1:]:
            oof = oof.unionByName(r.predictions)
        out.oof = oof
    return out


def score_on(individual: Individual, problem: Problem, fitted: models.Fitted, states: dict[str, State], df: DataFrame) -> float:
    """Metric of a fitted recipe on other rows."""
    predictions = fitted.predict(apply_fitted(individual, df, states), F.col(problem.rid), F.col("__y").alias("y"))
    return compute_metric(predictions, problem.task, problem.metric, problem.n_classes)
