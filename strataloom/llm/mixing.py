"""Mix the sources of a corpus to target weights by systematic sampling (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

#: Rows that one window partition of the prefix sum may hold on average.
ROWS_PER_CELL = 100_000


def size_in_words(text: Column) -> Column:
    """Number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(text: Column) -> Column:
    """28 bits of a text's MD5, which any SQL engine can compute too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def mixing_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """Words to take from each source: (source, source_size, target).

    ``sizes`` has one row per source (source, source_size). Sources in code-point order, null last,
    get ``weights`` in turn and divide ``share`` of all words by them. A source stops at
    ``max_epochs`` times its size; the excess is divided again by weight until none is above. That
    fixed point has a closed form: with sources ordered by limit per weight, those before the first
    one that a common level no longer fills are at their limit, and the others get weight x level.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_limit = Window.orderBy("__limit_per_weight", F.col("source").isNull(), "source")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    df = sizes.withColumn("__weight", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    df = df.withColumn("__limit", F.col("source_size") * F.lit(float(max_epochs))).withColumn("__limit_per_weight", F.col("__limit") / F.col("__weight"))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))
    weight = F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))
    df = df.withColumn("__level", F.greatest(left, F.lit(0.0)) / weight)
    # The level rises as sources that can't fill it drop out and falls beyond, so the fixed point is its maximum.
    target = F.least(F.col("__limit"), F.col("__weight") * F.max("__level").over(everything))
    return df.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_epochs: float = 3.0,
    seed: int = 7,
) -> DataFrame:
    """Copies of each document in the mix: (doc_id, source, size, source_size, target, copies, taken).

    Systematic sampling within each source: the documents stand in a fixed order, each expects
    target / source_size copies, the running sum of these starts at an offset derived from the
    source and ``seed``, and a document comes once for every integer that the sum passes at it.
    The order goes by size, so the documents taken have the sizes of all, and the words taken come
    within about one large document of the target. Reruns agree.

    The running sum of equal expectations is (position x expectation), so a position is all that
    is needed. It is found without gathering a source in one task: documents are counted in cells
    (source, level of size, hash of id), the cells' counts are summed in order, and only the
    position within a cell needs a sort. Cells hold ``ROWS_PER_CELL`` rows on average at any size.

    Null or empty texts have size 0 and take 0 words; a source with no words has target 0. Null is
    a source of its own. Repeated rows count one by one; which of several rows that are equal in
    id and size is taken can't be told apart in the result. Other columns are ignored.
    """
    narrow = materialize(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), size_in_words(F.col(f"`{text_col}`")).alias("size")), "mix-sizes")
    level = F.length(F.bin("size"))
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    targets = mixing_targets(totals.select("source", "source_size"), weights, max_epochs)
    rows = narrow.count()
    cells = 1 << max(6, (max(1, rows // ROWS_PER_CELL) - 1).bit_length() + 1)
    keyed = narrow.withColumn("__level", level).withColumn("__part", (text_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % cells).cast("int"))
    counted = keyed.groupBy("source", "__level", "__part").agg(F.count(F.lit(1)).alias("__n"))
    ordered = Window.partitionBy("source").orderBy("__level", "__part").rowsBetween(Window.unboundedPreceding, -1)
    cell = counted.select("source", "__level", "__part", F.coalesce(F.sum("__n").over(ordered), F.lit(0)).alias("__base"))
    # One row per cell, and there are at most (sources x size levels x rows / ROWS_PER_CELL) of those.
    per_cell = cell.join(targets, cell["source"].eqNullSafe(targets["source"])).select(cell["source"], "__level", "__part", "__base", "source_size", "target")
    place = Window.partitionBy("source", "__level", "__part").orderBy("size", "doc_id")
    placed = keyed.withColumn("__at", F.row_number().over(place))
    joined = placed.alias("p").join(
        per_cell.alias("c"),
        F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p.__level") == F.col("c.__level")) & (F.col("p.__part") == F.col("c.__part")),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = text_hash(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("p.source"), F.lit("")))) / F.lit(float(1 << 28))
    upto = F.col("c.__base") + F.col("p.__at")
    copies = F.floor(upto * rate + offset) - F.floor((upto - 1) * rate + offset)
    copies = F.greatest(F.lit(0), F.least(copies, F.ceil(F.lit(float(max_epochs))))).cast("long")
    return joined.select("doc_id", F.col("p.source").alias("source"), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeat_documents(docs: DataFrame, copies: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` as often as its row of ``copies`` says.

    Rows are matched by id. Where ids repeat, the copies of an id are dealt to its rows in turn, so
    that their number stays the same; null ids are one id. Null and empty texts come as their copies
    say, an empty table gives an empty one, and columns of any name are kept.
    """
    own = lambda c: docs[f"`{c}`"]
    per_id = copies.groupBy(F.col("doc_id").alias("__id")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    joined = docs.join(per_id, own(id_col).eqNullSafe(per_id["__id"]))
    single = joined.where("__rows = 1").withColumn("__times", F.col("__copies"))
    turn = F.row_number().over(Window.partitionBy("__id").orderBy(*[own(c).cast("string") for c in docs.columns])) - 1
    several = joined.where("__rows > 1").withColumn("__times", F.floor(F.col("__copies") / F.col("__rows")) + F.when(turn < F.col("__copies") % F.col("__rows"), 1).otherwise(0))
    every = single.unionByName(several) if per_id.where("__rows > 1").limit(1).count() else single
    every = every.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    return every.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
