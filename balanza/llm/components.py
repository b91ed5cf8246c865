"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from balanza.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it is connected to.

    Each round is one grouped minimum per side and one join, so a node of any degree is only ever
    reduced, never collected. Rounds stop when the edges no longer change; their number grows with the
    logarithm of the longest chain. Loops and repeated edges are allowed; no edges give no rows.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour of a goes to the smallest of a's neighbourhood
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour of a, and a itself, goes to the smallest
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        now = cut(
            joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
            .filter("a <> b").distinct()
        )
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
    return nodes.join(now.groupBy("a").agg(F.min("b").alias("m")), F.col("node") == F.col("a"), "left").select(
        "node", F.coalesce("m", "node").alias("root")
    )
