"""Connected components of a link table, without gathering links anywhere.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step is a minimum by
node and a join on the node, so a node with very many links is pre-aggregated on the map side
and its links stay where they are: the nodes with the most links get their minimum by broadcast. Each step is cut with
a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piispan.llm.common import cut, join_hot


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: a node's greater neighbours go to its least neighbour; small: itself and its lesser ones do."""
    a, b = ("a", "b")
    if large:
        both = links.select(a, b).union(links.select(F.col(b).alias(a), F.col(a).alias(b)))
    else:
        both = links.select(F.greatest(a, b).alias(a), F.least(a, b).alias(b))
    least = both.groupBy(a).agg(F.min(F.least(a, b)).alias("m"), F.count("*").alias("n"))
    joined = join_hot(both, least, a)
    if large:
        out = joined.filter(F.col(b) > F.col(a)).select(F.col(b).alias(a), F.col("m").alias(b))
    else:
        out = joined.select(F.col(b).alias(a), F.col("m").alias(b)).union(least.select(a, F.col("m").alias(b)))
    return out.filter(F.col(a) != F.col(b)).distinct()


def components(links: DataFrame) -> DataFrame:
    """`links` has comparable columns a and b; the result has node, root (the least node reachable).

    Nodes without links, or with links to themselves only, are not in the result.
    """
    links = cut(links.filter(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        links = cut(_star(cut(_star(links, large=True)), large=False))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
