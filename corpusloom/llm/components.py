"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: a node's neighbours (the larger ones, or the others and itself) link to its smallest neighbour."""
    if large:
        both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    joined = both.join(least, "src")
    if large:
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    else:
        out = joined.select(F.col("dst").alias("src"), F.col("least").alias("dst")).union(least.select("src", F.col("least").alias("dst")))
    return out.where("src <> dst").distinct()


def connected(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of links(src, dst); self-links and repeats are harmless.

    Rounds are written to the shared folder; their number grows with the logarithm of the node count.  An empty link table
    gives an empty result; rows with a null end are left out.
    """
    edges = written(links.where("src <> dst").select("src", "dst").distinct(), "edges")
    before = None
    while True:
        old, edges = edges, written(_star(_star(edges, True), False), "edges")
        discard(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = edges.select(F.col("dst").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
