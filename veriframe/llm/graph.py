"""Connected components of links that stay in tables.

Alternating large-star and small-star steps turn the links into one star for each component, with its smallest node in
the middle.  A step takes the smallest neighbour of each node (summed up before the shuffle) and joins it back to the
links, so a node with very many links is split by the adaptive skew join.  Links never go to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _is_stars(links: DataFrame) -> bool:
    """Whether every larger node has one link, to a node without smaller ones."""
    n = links.agg(F.count("*").alias("n"), F.count_distinct("hi").alias("d")).first()
    if n.n != n.d:
        return False
    return not links.select(F.col("lo").alias("hi")).join(links.select("hi"), "hi", "left_semi").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """``links`` has two columns of one integer type.  Gives node and component (the smallest node) for every node that
    has a link to another one; materialized.  Self-links, repeated links and either direction are fine."""
    a, b = links.columns
    now = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    now = materialize(now, "links")
    while not _is_stars(now):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialize(large, "links")
        discard(now)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        small = small.select("hi", F.col("m").alias("lo")).union(small.where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        now = materialize(small.distinct(), "links")
        discard(large)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo").distinct().select("lo", "lo"))
