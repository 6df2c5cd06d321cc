"""Connected components by alternating stars, for graphs of any size and any hub.

Every node ends up pointing at the least node it can reach. A round replaces, at each node,
the larger neighbours' edges by edges to the least neighbour (large star), then the smaller
neighbours' (small star). The minima are map-side combined, so a hub with very many
neighbours costs a shuffle of its edges and no task holds them; edges never become more.
Edges compress so well that the size of their file says little: their number decides whether
Spark may broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.llm import store


def _least(rows: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    return rows.join(least.hint("merge") if many else least, "a")


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return _least(both.where("b > a"), least, many).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _least(down, least, many).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return (node, component) for every node of the edges; component is its least reachable node.

    Edges with a null end or equal ends link nothing; nodes without other edges are not returned.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = store.materialize(now.distinct(), "edges")
    many, state = 2 * now.count() * store.ROW_BYTES > store.SMALL_BYTES, None
    while True:
        after = store.materialize(_small_star(_large_star(now, many), many), "edges")
        store.discard(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if seen[0] == seen[2] and seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = seen
