"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id with a link; component is the smallest id reachable.

    Each step groups links by node for the smallest neighbour (combined before the shuffle) and
    joins it back, so no node's neighbours are gathered in one row; a node with very many is split
    by the adaptive skew join. Links meet again as stars after a few rounds; each round is written.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links = scratch.keep(links, "links")
    seen = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == seen or now[0] == 0:
            break
        seen = tuple(now)
        both = links.union(links.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = scratch.keep(large, "links")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        new = scratch.keep(joined.union(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        scratch.drop(links, large)
        links = new
    roots = links.select(F.col("v").alias("id")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
