"""Connected components by alternating stars, on edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import staged


def _nearest(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step.

    ``larger``: each node ties its larger neighbours to the least of its neighbourhood;
    otherwise each node ties itself and its smaller neighbours to the least of them.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if larger else both.where("b < a")
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = seen.join(least, "a").where("b > a" if larger else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        tied = tied.unionByName(least.select("a", F.col("m").alias("b")))
    return tied.where("a <> b")


def _all_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that ``edges`` (a, b: long) names; the component is its least node.

    Each round is written to the shared folder; rounds go on until the edges are
    stars around the least nodes.  Their number grows with the logarithm of the
    longest path.
    """
    current = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .where("a <> b").distinct(), "edges")
    while not _all_stars(current):
        current = staged(_nearest(_nearest(current, True), False).distinct(), "edges")
    centres = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
