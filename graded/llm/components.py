"""Connected components of an edge table, by alternating large and small
stars. Every round is two joins of the edges with each node's smallest
neighbour; those are written tables, like the rounds themselves, so that Spark
can split the edges of a hot node in the join, and a lost executor repeats one
step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROUNDS = 60  # far beyond log2 of any number of nodes; reaching it is an error


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: u, v. Large star: every larger neighbour of a node is linked
    to the smallest one around. Small star: every smaller neighbour, and the
    node itself, is."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "components-low")
        kept = both.where("v > u")
        return (
            kept.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
    down = both.where("v < u")
    low = written(down.groupBy("u").agg(F.min("v").alias("m")), "components-low")
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return linked.unionAll(own).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (longs). Returns node, root for every node that isn't
    the smallest of its component."""
    now = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(),
        "components",
    )
    state = None
    for _ in range(ROUNDS):
        was = state
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == was or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = written(_star(_star(now, large=True), large=False), "components")
    raise RuntimeError("the components didn't settle")
