"""Algorithms on a bounded sample of points, in numpy: spanning tree, clusterings, outliers, embedding."""

from __future__ import annotations

import numpy as np


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-1 x 2 edges, lengths) of the Euclidean minimum spanning tree, by Prim's method in O(n^2)."""
    n = len(x)
    best, source, left = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    at, edges, lengths = 0, [], []
    for _ in range(n - 1):
        left[at] = False
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = left & (d < best)
        best[closer], source[closer] = d[closer], at
        at = int(np.argmin(np.where(left, best, np.inf)))
        edges.append((source[at], at))
        lengths.append(best[at])
    return np.array(edges, int).reshape(-1, 2), np.array(lengths)


class Sets:
    """Disjoint sets with sizes."""

    def __init__(self, n: int):
        self.parent, self.size = list(range(n)), [1] * n

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.size[min(a, b)] += self.size[max(a, b)]

    def labels(self) -> np.ndarray:
        """1, 2, ... in the order of the sets' first members."""
        roots = [self.find(i) for i in range(len(self.parent))]
        names = {r: k + 1 for k, r in enumerate(dict.fromkeys(roots))}
        return np.array([names[r] for r in roots])


def gini(sizes: np.ndarray) -> float:
    s = np.sort(np.asarray(sizes, float))
    n = len(s)
    return float(((2 * np.arange(1, n + 1) - n - 1) * s).sum() / ((n - 1) * s.sum())) if n > 1 else 0.0


def genie(x: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """Genie: merge along spanning-tree edges, shortest first; while cluster sizes are less equal
    than ``threshold``, the next merge has to involve a smallest cluster."""
    edges, lengths = spanning_tree(x)
    sets, waiting = Sets(len(x)), edges[np.argsort(lengths, kind="stable")].tolist()
    for _ in range(max(0, len(x) - k)):
        roots = {sets.find(i) for i in range(len(x))}
        sizes = np.array([sets.size[r] for r in roots])
        pick = 0
        if gini(sizes) > threshold:
            least = sizes.min()
            pick = next((i for i, (a, b) in enumerate(waiting) if least in (sets.size[sets.find(a)], sets.size[sets.find(b)])), 0)
        a, b = waiting.pop(pick)
        sets.join(a, b)
    return sets.labels()


def lumbermark(x: np.ndarray, k: int, min_size: int) -> np.ndarray:
    """Cut the longest spanning-tree edges that leave at least ``min_size`` points on both sides, until there are k parts."""
    edges, lengths = spanning_tree(x)
    kept = list(range(len(edges)))
    for e in np.argsort(-lengths, kind="stable"):
        trial, sets = [i for i in kept if i != e], Sets(len(x))
        for i in trial:
            sets.join(*edges[i])
        if min(sets.size[sets.find(int(v))] for v in edges[e]) >= min_size:
            kept = trial
            if len(edges) - len(kept) == k - 1:
                break
    sets = Sets(len(x))
    for i in kept:
        sets.join(*edges[i])
    return sets.labels()


def deadwood(x: np.ndarray, factor: float = 1.5) -> np.ndarray:
    """1 for points whose every spanning-tree edge is longer than the upper quartile plus ``factor`` interquartile ranges."""
    edges, lengths = spanning_tree(x)
    low, high = np.percentile(lengths, [25, 75])
    least = np.full(len(x), np.inf)
    np.minimum.at(least, edges.ravel(), np.repeat(lengths, 2))
    return (least > high + factor * (high - low)).astype(int)


def neighbours(x: np.ndarray, k: int, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(indices, distances) of the k nearest other points."""
    square, at, far = (x**2).sum(axis=1), [], []
    for i in range(0, len(x), chunk):
        d = square[i : i + chunk, None] - 2 * x[i : i + chunk] @ x.T + square
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near = np.argsort(d, axis=1)[:, :k]
        at.append(near)
        far.append(np.sqrt(np.maximum(np.take_along_axis(d, near, 1), 0)))
    return np.concatenate(at), np.concatenate(far)


def umap_layout(x: np.ndarray, n_neighbors: int, dens_scale: float, seed: int = 42, epochs: int = 120, dims: int = 2) -> np.ndarray:
    """Embedding after the published UMAP method: fuzzy neighbour graph, start from principal
    directions, attraction along edges and repulsion from random points. ``dens_scale`` scales the
    repulsion by local density."""
    n, k, rng = len(x), min(n_neighbors, len(x) - 1), np.random.default_rng(seed)
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    at, far = neighbours(z, k)
    rho, sigma = far[:, :1], np.ones((n, 1))
    low, high = np.full((n, 1), 1e-6), np.full((n, 1), 1e3)
    for _ in range(40):
        sigma = np.sqrt(low * high)
        big = np.exp(-np.maximum(far - rho, 0) / sigma).sum(axis=1, keepdims=True) > np.log2(k + 1)
        high, low = np.where(big, sigma, high), np.where(big, low, sigma)
    w = np.exp(-np.maximum(far - rho, 0) / sigma)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    y = np.zeros((n, dims))
    y[:, : min(dims, u.shape[1])] = (u * s)[:, :dims]
    y = y / max(np.abs(y).max(), 1e-9) * 10 + rng.normal(0, 1e-3, y.shape)
    density = 1 / (far.mean(axis=1) + 1e-9)
    density = 1 + dens_scale * (density / density.mean() - 1).clip(-0.9, 3)
    i, j, weight = np.repeat(np.arange(n), k), at.ravel(), w.ravel()
    for e in range(epochs):
        rate, used = 1 - e / epochs, rng.random(len(i)) < weight
        a, b = i[used], j[used]
        d = y[a] - y[b]
        q = (d**2).sum(axis=1, keepdims=True)
        pull = np.clip(-2 * d / (1 + q), -4, 4)
        np.add.at(y, a, rate * 0.5 * pull)
        np.add.at(y, b, -rate * 0.5 * pull)
        r = rng.integers(0, n, len(a))
        d = y[a] - y[r]
        q = (d**2).sum(axis=1, keepdims=True)
        np.add.at(y, a, rate * 0.1 * density[a, None] * np.clip(2 * d / ((0.01 + q) * (1 + q)), -4, 4))
    return y
