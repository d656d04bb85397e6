"""Splits and folds as columns. Orders come from MD5 of id and seed, so that any engine agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import ROWS_PER_RANGE, ranges_by


def shuffled(rid: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(rid).cast("string")).cast("binary"))


def numbered(df: DataFrame, order: list[Column], by: list[str] = (), bucket: Column | None = None) -> DataFrame:
    """``df`` with ``__i``, its place from 1 within ``by``. ``bucket`` (ascending with ``order``) cuts
    the order into ranges, so that no task sorts a whole class; the default is the start of the
    digest that the order starts with, of so many digits as the rows ask for. A row for each range
    and class is numbered in Spark and joined back."""
    digits = max(2, min(6, (max(1, df.count() // ROWS_PER_RANGE) - 1).bit_length() // 4 + 1))
    dealt = df.withColumn("__p", F.substring(order[0], 1, digits) if bucket is None else bucket.cast("int"))
    sizes = dealt.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__b"))
    placed = dealt.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__p").orderBy(*order)))
    same = F.col("__p").eqNullSafe(F.col("__q"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return placed.join(base, same).withColumn("__i", F.col("__r") + F.col("__b")).drop("__p", "__q", "__b", "__r", *[f"__by_{c}" for c in by])


def equal_width(i: Column, n: int, k: int) -> Column:
    """Bin of place i of n in k bins of equal width over [1, n], open on the left."""
    if n <= 1:
        return F.lit(1)
    return F.greatest(F.lit(1), F.floor(((i - 1) * k + (n - 2)) / F.lit(n - 1))).cast("int")


def fold_random(df: DataFrame, k: int, rid: str, seed: int = 0) -> DataFrame:
    n = df.count()
    return numbered(df, [shuffled(rid, seed), F.col(rid)]).withColumn("fold", equal_width(F.col("__i"), n, k)).drop("__i")


def fold_time(df: DataFrame, k: int, time_col: str, rid: str) -> DataFrame:
    """Contiguous blocks in time, nulls last."""
    n = df.count()
    t = F.col(time_col)
    dealt = ranges_by(df.withColumn("__t", F.unix_micros(t.cast("timestamp")).cast("double")), "__t", "__range")
    return numbered(dealt, [t.isNull(), t, F.col(rid)], bucket=F.col("__range")).withColumn("fold", equal_width(F.col("__i"), n, k)).drop("__i", "__t", "__range")


def fold_group(df: DataFrame, k: int, group_col: str, max_groups: int = 1_000_000) -> DataFrame:
    """Whole groups to the least loaded fold, largest first.

    Up to ``max_groups`` groups are dealt on the driver one by one. Of more, the largest are, and
    the others, which are small by then, are dealt in Spark: by a digest of the group, in shares
    that fill what is left of each fold.
    """
    g = F.coalesce(F.col(group_col).cast("string"), F.lit("NA"))
    sizes = df.groupBy(g.alias("g")).agg(F.count(F.lit(1)).alias("n"))
    counts = sizes.orderBy(F.desc("n"), "g").limit(max_groups).collect()
    load, rows = [0] * k, []
    for r in counts:
        f = load.index(min(load))
        load[f] += r["n"]
        rows.append((r.g, f + 1))
    table = df.sparkSession.createDataFrame(rows, "__g string, __fold int")
    joined = df.withColumn("__group", g).join(table, F.col("__group") == F.col("__g"), "left")
    fold = F.col("__fold")
    if len(counts) == max_groups:
        total = df.count()
        room = [max(0.0, total / k - x) for x in load]
        whole, upto, place = sum(room) or 1.0, 0.0, F.conv(F.substring(F.md5(F.col("__group").cast("binary")), 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))
        other = F.lit(k)
        for f in reversed(range(k)):
            upto = sum(room[: f + 1]) / whole
            other = F.when(place < F.lit(upto), F.lit(f + 1)).otherwise(other)
        fold = F.coalesce(fold, other)
    return joined.withColumn("fold", fold.cast("int")).drop("__group", "__g", "__fold")


def stratified_split(df: DataFrame, y: str, ratio: list[float], rid: str, seed: int = 0, regression: bool = False) -> DataFrame:
    """``part``: train, val or holdout. By class, rounded shares with at least one row for training;
    plainly over all rows for regression or one class."""
    n_levels = df.select(y).distinct().limit(2).count()
    total = sum(ratio)
    shares = [r / total for r in ratio]
    order = [shuffled(rid, seed), F.col(rid)]
    if regression or n_levels < 2:
        n = F.lit(df.count())
        placed = numbered(df, order)
    else:
        sizes = df.groupBy(F.col(y).alias("__stratum")).agg(F.count(F.lit(1)).alias("__n"))
        placed = numbered(df, order, [y]).join(F.broadcast(sizes), F.col(y).eqNullSafe(F.col("__stratum"))).drop("__stratum")
        n = F.col("__n")
    train = F.greatest(F.lit(1), F.round(n * shares[0])).cast("long")
    if len(shares) == 2:
        part = F.when(F.col("__i") <= train, "train").otherwise("val")
    else:
        val = F.greatest(F.when(n > train, 1).otherwise(0), F.round(n * shares[1])).cast("long")
        part = F.when(F.col("__i") <= train, "train").when(F.col("__i") <= train + val, "val").otherwise("holdout")
    return placed.withColumn("part", part).drop("__i", "__n")


def island_rows(df: DataFrame, islands: int, rid: str, seed: int = 0) -> DataFrame:
    """Rows cut at random into a part for each island."""
    n = df.count()
    return numbered(df, [shuffled(rid, seed), F.col(rid)]).withColumn("island", equal_width(F.col("__i"), n, islands)).drop("__i")


def island_validation(df: DataFrame, ratio: tuple[float, float], rid: str, seed: int = 0) -> DataFrame:
    """Each island's own train and validation rows."""
    sizes = df.groupBy(F.col("island").alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    cut = F.floor(F.col("__n") * F.lit(ratio[0] / (ratio[0] + ratio[1])))
    placed = numbered(df, [shuffled(rid, seed), F.col(rid)], ["island"]).join(F.broadcast(sizes), F.col("island") == F.col("__g"))
    return placed.withColumn("part", F.when(F.col("__i") <= cut, "train").otherwise("val")).drop("__i", "__g", "__n")


def low_fidelity(df: DataFrame, fraction: float, rid: str, seed: int = 0, least_rows: int = 30, least_kept: int = 20) -> DataFrame:
    """The rows of least hash, for quick screening; small parts stay whole."""
    n = df.count()
    if n < least_rows:
        return df
    keep = max(least_kept, -(-int(fraction * n * 1_000_000) // 1_000_000))
    return numbered(df, [shuffled(rid, seed), F.col(rid)]).where(F.col("__i") <= keep).drop("__i")
