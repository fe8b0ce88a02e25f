"""Connected components of a link table, by alternating star contraction.

Each round is two aggregations and two joins on node ids; the number of rounds
grows with the logarithm of the longest chain.  A hub's links are reduced by
min() before the shuffle, and the join back is one that adaptive execution can
split, so a hub may hold any share of the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v), u > v.  Large: greater neighbours move to the least one of
    the neighbourhood; small: the node and its lesser neighbours do."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))  # repeats go in the next step
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    out = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links(u, v), any order, repeats and loops allowed -> node, component:
    every node with a link to another one, and the least node it can reach.
    Null ends are left out."""
    links = links.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialise(links, "links")
    before = _state(links)
    while True:
        links = materialise(_star(_star(links, True), False), "links")
        now = _state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
