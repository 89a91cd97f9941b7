"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, staged_and_told


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each directed edge with the least of u and all of u's neighbours. The minimum is pre-aggregated, so a hub costs no task of its own."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b: long); root is the component's smallest node.

    Self links and repeated links are allowed; a link with a null end is ignored. Each round is written to
    the shared folder, so a lost executor costs one round at most.
    """
    edges = staged(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # larger neighbours go to the least
        star = _least(large)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).where("u != v")
        edges, now = staged_and_told(small.distinct(), "links", F.count("*").alias("links"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        if now == seen or not now["links"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = now
