"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.skew import join_groups
from larkspur.llm.workspace import Scratch

#: Neighbours of a node that one task may join; beyond them a star's centre is joined by broadcast.
STAR_ROWS = 500_000


def _star(edges: DataFrame, large: bool, scratch: Scratch, rows: int) -> DataFrame:
    """edges: a > b.  Joins each node's larger (or smaller) neighbours to the least node around it."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    joined = near.join(least, "u") if rows <= STAR_ROWS else join_groups(near, scratch.stage(least), ["u"], "n", rows)
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each a has one edge, to a node that is no a itself."""
    both = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    busy = both.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")
    return not busy.limit(1).count()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: (a, b), in any order, loops and repeats allowed.  Returns node, component (the least node in reach), as a table of ``scratch``.

    The number of rounds grows with the logarithm of the nodes; each round is a written table.
    """
    edges = scratch.stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows = edges.count()
    while rows and not _settled(edges):
        stars = scratch.stage(_star(edges, True, scratch, 2 * rows))
        after = scratch.stage(_star(stars, False, scratch, rows))
        scratch.drop(edges, stars)
        edges = after
    ends = edges.select("b").distinct()
    out = scratch.stage(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(ends.select(F.col("b"), F.col("b"))))
    scratch.drop(edges)
    return out
