"""Metrics of predictions, each higher-is-better as a fitness; computed by aggregates over (label, prediction)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import OPTIONS
from ..registry import METRICS
from .linalg import correlation
from .ranges import running_totals

EPSILON = 1e-15


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), p))


def exp_logloss(y: Column, p: Column) -> Column:
    q = clipped(p)
    return F.exp(F.avg(F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))))


def exp_mlogloss(y: Column, probabilities: Column) -> Column:
    """``y`` is a class number from 0, ``probabilities`` an array."""
    return F.exp(F.avg(F.log(clipped(F.element_at(probabilities, (y + 1).cast("int"))))))


def f1(y: Column, p: Column) -> Column:
    hit = p >= 0.5
    tp, fp, fn = (F.sum(F.when(c, 1).otherwise(0)) for c in (hit & (y == 1), hit & (y != 1), ~hit & (y == 1)))
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def neg_mae(y: Column, p: Column) -> Column:
    return -F.avg(F.abs(y - p))


def neg_rmse(y: Column, p: Column) -> Column:
    return -F.sqrt(F.avg((y - p) * (y - p)))


def calibrated_rmse(y: Column, p: Column) -> Column:
    """Error left after the best line through the predictions: sd(y) * sqrt(1 - r^2)."""
    sy, sp, n = F.coalesce(F.stddev_samp(y), F.lit(0.0)), F.coalesce(F.stddev_samp(p), F.lit(0.0)), F.count(y)
    r = F.coalesce(correlation(y, p), F.lit(0.0))
    flat = F.sqrt(F.avg(y * y) - 2 * F.avg(y) * F.avg(p) + F.avg(p) * F.avg(p))
    return F.when((n <= 1) | (sy < 1e-9), F.lit(0.0)).when(sp < 1e-9, flat).otherwise(sy * F.sqrt(F.greatest(F.lit(0.0), 1 - r * r)))


def auc(df: DataFrame, y: str = "y", p: str = "p") -> float:
    """Rank-sum statistic with average ranks of ties, from counts by distinct prediction."""
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("x")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg")).persist()
    try:
        totals = counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
        if not totals.pos or not totals.neg:
            return 0.5
        won = running_totals(counts, "x", ["neg"]).agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("w")).first().w
        return float(won) / (totals.pos * totals.neg)
    finally:
        counts.unpersist()


def multiclass_auc(df: DataFrame, n_classes: int, y: str = "y", probabilities: str = "p") -> float:
    """Mean of the one-against-rest statistics."""
    own = [auc(df.select((F.col(y) == k).cast("int").alias("y"), F.element_at(probabilities, k + 1).alias("p"))) for k in range(n_classes)]
    return float(np.mean(own))


#: Values around a median that are collected for it, on average.
AROUND = 40_000


def absolute_errors(df: DataFrame, columns: list[Column], n: int) -> list[float]:
    """Mean absolute deviation of each column (of about ``n`` rows) from its exact median.

    Approximate quantiles bracket the medians; one aggregate counts and sums what lies outside and
    collects what lies inside, where the median is then picked. A bracket that missed it is widened.
    """
    named = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    accuracy = max(1000, 4 * n // AROUND)
    wide, todo, found = 1.5 / accuracy, list(range(len(columns))), {}
    while todo:
        low, high = max(0.0, 0.5 - wide), min(1.0, 0.5 + wide)
        cuts = named.agg(*[F.percentile_approx(f"c{i}", F.array(F.lit(low), F.lit(high)), accuracy).alias(f"q{i}") for i in todo]).first()
        aggregates = []
        for i in todo:
            x, (a, b) = F.col(f"c{i}"), cuts[f"q{i}"] or (0.0, 0.0)
            below, above, a, b = x < F.lit(a), x > F.lit(b), F.lit(a), F.lit(b)
            # Equal values are one entry, so a value that most rows share doesn't fill the list.
            aggregates += [F.count(x).alias(f"n{i}"), F.count(F.when(below, 1)).alias(f"b{i}"), F.sum(F.when(below, a - x)).alias(f"s{i}"), F.count(F.when(above, 1)).alias(f"a{i}"), F.sum(F.when(above, x - b)).alias(f"t{i}")]
            aggregates += [F.count(F.when(x == a, 1)).alias(f"e{i}"), F.count(F.when((x == b) & (b != a), 1)).alias(f"f{i}"), F.collect_list(F.when((x > a) & (x < b), x)).alias(f"v{i}")]
        r = named.agg(*aggregates).first()
        missed = []
        for i in todo:
            count, before = r[f"n{i}"], r[f"b{i}"]
            if not count:
                found[i] = 0.0
                continue
            a, b = cuts[f"q{i}"]
            inside = np.sort(np.array(r[f"v{i}"], float))
            values, times = np.concatenate([[a], inside, [b]]), np.concatenate([[r[f"e{i}"]], np.ones(len(inside), int), [r[f"f{i}"]]])
            upto = before + np.cumsum(times)
            first, second = (count - 1) // 2, count // 2
            if low > 0 and (first < before or second >= upto[-1]):
                missed.append(i)
                continue
            m = (values[np.searchsorted(upto, first, side="right")] + values[np.searchsorted(upto, second, side="right")]) / 2
            outside = (r[f"s{i}"] or 0.0) + before * (m - a) + (r[f"t{i}"] or 0.0) + r[f"a{i}"] * (b - m)
            found[i] = float(outside + (times * np.abs(values - m)).sum()) / count
        todo, wide = missed, 8 * wide
    return [found[i] for i in range(len(columns))]


def calibrated_mae(df: DataFrame, y: str = "y", p: str = "p", rounds: int = 8, grid: int = 9) -> float:
    """Least mean absolute error over lines through the predictions.

    The objective is convex in slope and intercept; for each slope the best intercept is a median.
    Rounds of a grid of slopes around the least-squares one narrow down; each is two aggregates.
    """
    r = df.agg(F.count(y).alias("n"), F.stddev_samp(y).alias("sy"), F.stddev_samp(p).alias("sp"), F.coalesce(correlation(F.col(y), F.col(p)), F.lit(0.0)).alias("r")).first()
    if r.n <= 1 or (r.sy or 0) < 1e-9:
        return 0.0
    if (r.sp or 0) < 1e-9:
        return absolute_errors(df, [F.col(y)], r.n)[0]
    centre, width, best = r.r * r.sy / r.sp, 2 * r.sy / r.sp, math.inf
    for _ in range(rounds):
        slopes = np.linspace(centre - width, centre + width, grid)
        errors = absolute_errors(df, [F.col(y) - F.lit(float(b)) * F.col(p) for b in slopes], r.n)
        i = int(np.argmin(errors))
        best, centre, width = min(best, float(errors[i])), float(slopes[i]), 2 * width / (grid - 1)
    return best


def minimise(objective: Callable[[np.ndarray], np.ndarray], low: float, high: float, rounds: int = 7, grid: int = 17) -> float:
    """Minimum of a function that is evaluated on a whole grid at once."""
    for _ in range(rounds):
        points = np.linspace(low, high, grid)
        i = int(np.argmin(objective(points)))
        low, high = points[max(0, i - 1)], points[min(grid - 1, i + 1)]
    return (low + high) / 2


def logloss_at(z: Column, target: Column, temperature: float) -> Column:
    q = clipped(1 / (1 + F.exp(-z / F.lit(float(temperature)))))
    return -F.avg(target * F.log(q) + (1 - target) * F.log(1 - q))


def ts_refinement(df: DataFrame, y: str = "y", p: str = "p", alpha: float = 1.0, logits: bool = False) -> float:
    """Log-loss left after temperature scaling, whose temperature is fitted on Laplace-smoothed
    labels; each round of the search scores all its temperatures in one aggregate."""
    n = df.agg(F.sum((F.col(y) == 1).cast("long")).alias("one"), F.sum((F.col(y) != 1).cast("long")).alias("zero")).first()
    q = clipped(F.col(p))
    z = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.coalesce(F.nanvl(F.col(p) if logits else F.log(q / (1 - q)), F.lit(0.0)), F.lit(0.0))))
    base = df.select(z.alias("z"), F.col(y).cast("double").alias("y"), F.when(F.col(y) == 1, F.lit(((n.one or 0) + alpha) / ((n.one or 0) + 2 * alpha))).otherwise(F.lit(alpha / ((n.zero or 0) + 2 * alpha))).alias("s"))

    def objective(points):
        row = base.agg(*[logloss_at(F.col("z"), F.col("s"), t).alias(f"t{i}") for i, t in enumerate(points)]).first()
        return np.array(list(row), float)

    best = minimise(objective, 0.001, 10.0)
    return float(base.agg(logloss_at(F.col("z"), F.col("y"), best).alias("l")).first().l)


def ts_refinement_multiclass(df: DataFrame, n_classes: int, y: str = "y", probabilities: str = "p", alpha: float = 1.0) -> float:
    """The same with a softmax over ``n_classes`` and labels smoothed by class counts."""
    counts = {int(r[0]): int(r[1]) for r in df.groupBy(y).count().collect()}
    n = sum(counts.values())
    z = [F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.log(clipped(F.element_at(probabilities, k + 1))))) for k in range(n_classes)]
    soft = []
    for k in range(n_classes):
        s = F.lit(0.0)
        for c, m in counts.items():
            mass = (m + alpha) / (m + 2 * alpha) if c == k else (alpha / (m + 2 * alpha)) / max(1, n - m) * counts.get(k, 0)
            s = F.when(F.col(y) == c, F.lit(mass)).otherwise(s)
        soft.append(s)
    base = df.select(*[c.alias(f"z{k}") for k, c in enumerate(z)], *[c.alias(f"s{k}") for k, c in enumerate(soft)], *[(F.col(y) == k).cast("double").alias(f"h{k}") for k in range(n_classes)])

    def loss(t, kind):
        scaled = [F.col(f"z{k}") / F.lit(float(t)) for k in range(n_classes)]
        top = F.greatest(*scaled) if n_classes > 1 else scaled[0]
        whole = sum((F.exp(s - top) for s in scaled[1:]), F.exp(scaled[0] - top))
        return -F.avg(sum((F.col(f"{kind}{k}") * F.log(clipped(F.exp(s - top) / whole)) for k, s in enumerate(scaled)), F.lit(0.0)))

    best = minimise(lambda points: np.array(list(base.agg(*[loss(t, "s").alias(f"t{i}") for i, t in enumerate(points)]).first()), float), 0.001, 10.0)
    return float(base.agg(loss(best, "h").alias("l")).first().l)


#: Metrics of each task; the first is the default.
VALID = {
    "classification": ("logloss", "auc", "f1", "ts_refinement"),
    "multiclass": ("logloss", "auc", "ts_refinement"),
    "regression": ("rmse", "mae", "cal_rmse", "cal_mae"),
}


def compute_metric(df: DataFrame, task: str, metric: str | Callable = "default", n_classes: int = 2, y: str = "y", p: str = "p") -> float:
    """Fitness of predictions, higher is better. ``p`` is an array of probabilities for multiclass tasks."""
    if callable(metric):
        return float(metric(df, y, p))
    if metric in METRICS:
        return float(METRICS[metric](df, y, p))
    if task not in VALID:
        raise ValueError(f"unknown task {task!r}; known: {', '.join(VALID)}")
    metric = VALID[task][0] if metric == "default" else metric
    if metric not in VALID[task]:
        raise ValueError(f"metric {metric!r} isn't for {task}; valid: {', '.join(VALID[task])}")
    if metric == "auc":
        return multiclass_auc(df, n_classes, y, p) if task == "multiclass" else auc(df, y, p)
    if metric == "ts_refinement":
        return math.exp(-(ts_refinement_multiclass(df, n_classes, y, p) if task == "multiclass" else ts_refinement(df, y, p)))
    if metric == "cal_mae":
        return -calibrated_mae(df, y, p)
    a, b = F.col(y), F.col(p)
    column = exp_mlogloss(a, b) if task == "multiclass" else {"logloss": exp_logloss, "f1": f1, "rmse": neg_rmse, "mae": neg_mae, "cal_rmse": lambda y, p: -calibrated_rmse(y, p)}[metric](a, b)
    value = df.agg(column.alias("v")).first().v
    return float("-inf") if value is None else float(value)


def complexity_penalty(n_genes: int, n_samples: float, best: float | None = None, baseline: float | None = None, task: str = "classification", strength: float = 0.0, mode: str = "bic_dynamic", floor: float = 0.2, target: str = "all_features", n_features: int | None = None) -> float:
    """Compound penalty of k features or genes: expm1(k * log1p(p)), where p shrinks with samples and,
    in dynamic modes, with the part of the way from the baseline to the ideal that is left."""
    k = n_genes if target == "genes" or n_features is None else n_features
    if strength <= 0 or k <= 0 or mode == "none":
        return 0.0
    n = max(2.0, float(n_samples or 2))
    base = {"pac_bayes": strength / (2 * math.sqrt(n)), "bic": strength * math.log(n) / (2 * n)}.get(mode.removesuffix("_dynamic"), 0.0)
    if mode.endswith("_dynamic") and best is not None and baseline is not None and math.isfinite(best) and math.isfinite(baseline):
        ideal = 1.0 if task in ("classification", "multiclass") else 0.0
        gap = 1.0 if abs(ideal - baseline) <= 1e-12 else (ideal - best) / (ideal - baseline)
        base *= max(floor, min(1.0, gap))
    return math.expm1(k * math.log1p(base)) if base > 0 else 0.0


def penalised(raw: float, penalty: float, task: str) -> float:
    if task in ("classification", "multiclass"):
        return raw - (1 - raw) * penalty
    return raw * (1 + penalty) if raw <= 0 else raw * (1 - penalty)


def headroom_closed(fitness: float, baseline: float, task: str) -> float:
    """Part of the way from the baseline to the ideal that a fitness has gone."""
    gap = (1.0 if task in ("classification", "multiclass") else 0.0) - baseline
    return 0.0 if abs(gap) < 1e-6 else (fitness - baseline) / gap


def jaccard_distance(a: set, b: set) -> float:
    return 1 - len(a & b) / len(a | b) if a | b else 0.0


def normalised_importances(folds: list[dict[str, float]], least: float | None = None) -> dict[str, float]:
    """Mean over folds (absent is 0), to sum 1, those below ``least`` (an option by default) as 0."""
    least = OPTIONS["importance_threshold"] if least is None else least
    names = dict.fromkeys(n for f in folds for n in f)
    mean = {n: sum(f.get(n, 0.0) for f in folds) / len(folds) for n in names}
    total = sum(mean.values())
    return {n: (v / total if v / total >= least else 0.0) if total > 0 else 0.0 for n, v in mean.items()}
