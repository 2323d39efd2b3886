"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.work import Work


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: the neighbours of a node (the larger, or the smaller and itself)
    are linked to the least of them.  Minima are combined before they shuffle."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, work: Work) -> DataFrame:
    """(node, comp) for every node of an edge, comp being the least node reachable.

    ``edges`` has columns a and b.  Steps repeat until the edges are stars around
    their least nodes, some log of the longest chain; each step is a written table.
    """
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = work.saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while (found := tuple(mark(now))) != seen:
        seen = found
        if not found[0]:
            break
        after = work.saved(_stars(_stars(now, True), False))
        work.drop(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
