"""Running totals over an ordered column without one task that sees all of it."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range holds on average.
ROWS_PER_RANGE = 50_000


def ranges_by(df: DataFrame, x: str, part: str = "__part", ranges: int | None = None) -> DataFrame:
    """``df`` with the range of its numeric column ``x``, by approximate quantiles; nulls are the last
    range. There are as many ranges as rows ask for, and a row finds its own by binary search."""
    ranges = max(8, min(10_000, df.count() // ROWS_PER_RANGE)) if ranges is None else ranges
    cuts = df.agg(F.percentile_approx(x, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 20 * ranges).alias("p")).first().p
    cuts = sorted({float(c) for c in cuts or []})
    if not cuts:
        return df.withColumn(part, F.lit(0))
    value = df.withColumn("__x", F.col(f"`{x}`").cast("double"))
    placed = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__x", outputCol=part, handleInvalid="keep").transform(value)
    return placed.withColumn(part, F.col(part).cast("int")).drop("__x")


def running_totals(df: DataFrame, x: str, sums: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` (distinct ``x``) with ``<s>_before``: the sum of s over all rows of smaller ``x``.

    Rows are dealt to ranges of ``x`` by approximate quantiles; a window adds up within a range, and
    the ranges' own totals, one row each, are added up on the driver. ``df`` is read several times,
    so callers keep it if it costs much.
    """
    dealt = ranges_by(df, x, ranges=ranges)
    totals = {r["__part"]: r for r in dealt.groupBy("__part").agg(*[F.sum(s).alias(s) for s in sums]).collect()}
    rows, before = [], dict.fromkeys(sums, 0)
    for p in sorted(totals):
        rows.append((p, *[float(before[s]) for s in sums]))
        for s in sums:
            before[s] += totals[p][s] or 0
    base = df.sparkSession.createDataFrame(rows, "__p int, " + ", ".join(f"`{s}_base` double" for s in sums))
    window = Window.partitionBy("__part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(base), F.col("__part") == F.col("__p"))
    for s in sums:
        joined = joined.withColumn(f"{s}_before", F.col(f"{s}_base") + F.coalesce(F.sum(s).over(window), F.lit(0)))
    return joined.drop("__part", "__p", *[f"{s}_base" for s in sums])
