"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logshield.llm.common import cut, discard


def _contract(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links a > b."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, root being the smallest node reachable.

    `links` has columns a and b. Each round replaces the links by as many or fewer that reach
    the same nodes; hubs stay single rows per neighbour, so no group is ever gathered. The
    number of rounds grows with the logarithm of the longest path; they go on until all links are
    stars. The result is cut."""
    e = _contract(_ordered(links))
    while not _stars(e):
        e, was = _contract(e), e
        discard(was)
    root = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    got = cut(root.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
    discard(e)
    return got


def _stars(e: DataFrame) -> bool:
    """Has every node one link to a smaller one, or else none but from larger ones?"""
    ends = e.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1").isEmpty()
