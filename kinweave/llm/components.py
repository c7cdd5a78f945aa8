"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _fingerprint(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): component is the smallest
    node id that can be reached. Self-loops and repeated edges are harmless; rows with a null end
    are ignored; without edges the result is empty.

    Each round is two star operations. A node's neighbours are never gathered: the star's centre
    comes from a partially aggregated minimum, which is joined back to the edges. Both inputs of
    that join are read from the checkpoint folder, so adaptive execution can split the edges of a
    node of high degree over many tasks.
    """
    live = edges.where("a is not null and b is not null and a <> b")
    e = cut(live.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _fingerprint(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        centre = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # large star: every larger neighbour is linked to the smallest of the neighbourhood
        large = cut(both.join(centre, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: every smaller neighbour, and the node itself, is linked to the smallest
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        linked = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(linked.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _fingerprint(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
