"""Tuned evaluators: Latin hypercube designs, then expected improvement under a Gaussian process."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from ..registry import EVALUATORS, register_evaluator
from .models import Evaluator


def latin_hypercube(n: int, dims: int, rng: np.random.Generator) -> np.ndarray:
    return np.column_stack([(rng.permutation(n) + rng.random(n)) / n for _ in range(dims)]) if dims else np.zeros((n, 0))


def expected_improvement(x: np.ndarray, y: np.ndarray, candidates: np.ndarray, length: float = 0.3, noise: float = 1e-4) -> np.ndarray:
    """Of each candidate over the best y, under a process with a squared-exponential kernel."""
    scale = y.std() or 1.0
    z = (y - y.mean()) / scale
    kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * length**2))
    k = kernel(x, x) + noise * np.eye(len(x))
    cross = kernel(candidates, x)
    solve = np.linalg.solve(k, np.column_stack([z, cross.T]))
    mean, sd = cross @ solve[:, 0], np.sqrt(np.maximum(1 - np.einsum("ij,ji->i", cross, solve[:, 1:]), 1e-12))
    gain = (mean - z.max()) / sd
    density, share = np.exp(-(gain**2) / 2) / math.sqrt(2 * math.pi), np.array([0.5 * (1 + math.erf(g / math.sqrt(2))) for g in gain])
    return sd * (gain * share + density)


def decode(space: dict, unit: np.ndarray) -> dict:
    """Parameters from a point of the unit cube. A range is (low, high); integers and logs by type; lists are choices."""
    out, at = {}, 0
    for name, spec in space.items():
        if not isinstance(spec, (list, tuple)):
            out[name] = spec  # fixed
            continue
        u, at = float(unit[at]), at + 1
        if isinstance(spec, list):
            out[name] = spec[min(int(u * len(spec)), len(spec) - 1)]
        elif all(isinstance(v, int) for v in spec):
            out[name] = min(spec[1], spec[0] + int(u * (spec[1] - spec[0] + 1)))
        else:
            out[name] = spec[0] + u * (spec[1] - spec[0])
    return out


def optimise(objective: Callable[[dict], float], space: dict, iterations: int = 5, design: int = 8, seed: int = 0) -> tuple[dict, float]:
    """(best parameters, value) of a maximisation."""
    rng, dims = np.random.default_rng(seed), sum(isinstance(s, (list, tuple)) for s in space.values())
    x = latin_hypercube(max(design, dims + 2), dims, rng)
    y = np.array([objective(decode(space, u)) for u in x])
    for _ in range(iterations if dims else 0):
        candidates = np.vstack([rng.random((1000, dims)), np.clip(x[np.argmax(y)] + rng.normal(0, 0.1, (500, dims)), 0, 1)])
        new = candidates[np.argmax(expected_improvement(x, np.nan_to_num(y, neginf=np.nanmin(y[np.isfinite(y)]) if np.isfinite(y).any() else 0.0), candidates))]
        x, y = np.vstack([x, new]), np.append(y, objective(decode(space, new)))
    best = int(np.argmax(y))
    return decode(space, x[best]), float(y[best])


class Tuned(Evaluator):
    """Tunes the base evaluator on a split of the training rows, then fits it with what won."""

    def __init__(self, base: str, space: dict, name: str, iterations: int = 5, design: int = 8):
        self.base, self.space, self.name, self.iterations, self.design = base, space, name, iterations, design
        self.best_params: dict = {}

    def fit(self, df, features, label, task, n_classes=2, best_params=None, **params):
        from pyspark.sql import functions as F

        from ..functions.metrics import compute_metric

        base = EVALUATORS[self.base]
        if best_params is None:
            part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in features]), F.lit(4)) == 0
            train, val = df.where(~part), df.where(part)

            def objective(p: dict) -> float:
                fitted = base.fit(train, features, label, task, n_classes, **{**params, **p})
                return compute_metric(fitted.predict(val, F.col(f"`{label}`").alias("y")), task, "default", n_classes)

            best_params = optimise(objective, self.space, self.iterations, self.design)[0]
        self.best_params = best_params
        return base.fit(df, features, label, task, n_classes, **{**params, **best_params})


def make_tunable(base: str, space: dict, name: str | None = None, iterations: int = 5, design: int = 8) -> str:
    """Register ``<base>_mbo``; returns its name."""
    if base not in EVALUATORS:
        raise ValueError(f"unknown evaluator {base!r}")
    name = name or f"{base}_mbo"
    register_evaluator(name, Tuned(base, space, name, iterations, design))
    return name


if "lightgbm_mbo" not in EVALUATORS:
    from . import models  # noqa: F401  registers the base

    make_tunable("lightgbm", {"learning_rate": (0.01, 0.3), "max_depth": (3, 8), "subsample": (0.5, 1.0)})
