"""Linear algebra with one aggregate over the data: Gram matrices in Spark, eigenvectors on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_gram(df: DataFrame, columns: list[Column], weight: Column | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, means, sum of x x') of the columns, each row counted ``weight`` times; one scan."""
    p, w = len(columns), (F.lit(1.0) if weight is None else weight.cast("double"))
    named = df.select(w.alias("w"), *[c.alias(f"x{i}") for i, c in enumerate(columns)])
    sums = [F.sum(F.col("w") * F.col(f"x{i}")).alias(f"s{i}") for i in range(p)]
    products = [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(p) for j in range(i, p)]
    r = named.agg(F.sum("w").alias("n"), *sums, *products).first()
    n = float(r.n or 0)
    mean = np.array([float(r[f"s{i}"] or 0) for i in range(p)]) / max(n, 1e-300)
    gram = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            gram[i, j] = gram[j, i] = float(r[f"p{i}_{j}"] or 0)
    return n, mean, gram


def centred_gram(df: DataFrame, columns: list[Column]) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, means, sum of (x - m)(x - m)') of the columns; a first scan finds the means, as raw
    products lose all digits where a mean is large beside the deviation."""
    p = len(columns)
    named = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    r = named.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)]).first()
    mean = np.array([float(r[f"m{i}"] or 0) for i in range(p)])
    n, rest, gram = weighted_gram(named, [F.col(f"x{i}") - F.lit(float(m)) for i, m in enumerate(mean)])
    return n, mean + rest, gram - n * np.outer(rest, rest)


def directions(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the ``k`` largest; the entry of largest size of each is positive."""
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:k]
    values, vectors = values[order], vectors[:, order]
    for j in range(vectors.shape[1]):
        if vectors[np.argmax(np.abs(np.round(vectors[:, j], 12))), j] < 0:
            vectors[:, j] = -vectors[:, j]
    return values, vectors


def components_of(p: int) -> int:
    return max(2, round(np.log2(p))) if p > 0 else 2


def linear(columns: list[Column], weights: list[float]) -> Column:
    """Weighted sum of columns."""
    total = F.lit(0.0)
    for c, w in zip(columns, weights, strict=True):
        total = total + F.lit(float(w)) * c
    return total


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows that have both; null where one is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
