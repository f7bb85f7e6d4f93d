"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges without loops, smaller end first."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b): label is the smallest node of its component.

    Every round points each node at the smallest node around it, follows these pointers to their ends, and
    contracts the graph to the ends: only edges between different ends are left for the next round, so
    edges are joined about once.  All steps are joins and partial aggregates; each is written to the shared
    folder, and nothing but a test for emptiness reaches the driver.
    """
    left = materialize(_ordered(edges, "a", "b"), "edges")
    labels = materialize(left.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0), "labels")
    started = False
    while left.limit(1).count():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))
        ends = materialize(near, "pointers")
        while True:
            top = ends.select(F.col("node").alias("up"), F.col("up").alias("top"))
            further = materialize(ends.select("node", "up").join(top, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "pointers")
            discard(ends)
            ends = further
            if not ends.where("moved").limit(1).count():
                break
        if started:
            through = labels.join(ends.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        else:
            through = ends.select("node", F.col("up").alias("label"))
        through = materialize(through, "labels")
        x, y = (ends.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in ("a", "b"))
        contracted = materialize(_ordered(left.join(x, "a").join(y, "b"), "a_up", "b_up"), "edges")
        discard(left, labels, ends)
        left, labels, started = contracted, through, True
    return labels
