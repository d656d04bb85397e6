"""Connected components of links that no single machine could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(v, label) for each vertex of the undirected ``links`` (a, b): the least vertex reachable.

    Each round points every vertex at its least neighbour, if that is less, follows the pointers to
    their roots by doubling, and replaces the links by those between roots. A root that stays has
    taken in a neighbour, or has a lesser one in the next round; so two rounds halve the vertices
    at least, whatever the order of ids and the length of chains, and rounds end when no link is
    left. Minima combine before the shuffle, so vertices of many links are no hot spots; what a
    step gives is a table in the shared folder, so lost executors cost a step at most, and is
    deleted when the next step is written. Only counts reach the driver. Null ends, loops and
    repeated links do no harm.
    """
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        roots = written = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")), "roots")
        while True:
            up = roots.select(F.col("v").alias("label"), F.col("label").alias("next"))
            moved = materialize(roots.join(up, "label").select("v", F.col("label").alias("old"), F.col("next").alias("label")), "roots")
            discard(written)
            roots, written = moved.select("v", "label"), moved
            if not moved.where("old <> label").limit(1).count():
                break
        if labels is None:
            labels = materialize(roots, "labels")
        else:
            over = roots.select(F.col("v").alias("label"), F.col("label").alias("next"))
            named = materialize(labels.join(over, "label", "left").select("v", F.coalesce("next", "label").alias("label")), "labels")
            discard(labels)
            labels = named
        a, b = (roots.select(F.col("v").alias(c), F.col("label").alias(f"{c}_label")) for c in "ab")
        named = edges.join(a, "a").join(b, "b").select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b"))
        left = materialize(named.where("a <> b").distinct(), "links")
        discard(edges, written)
        edges = left
        if not edges.limit(1).count():
            discard(edges)
            return labels
