"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.shared import written


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one node only, which points to none."""
    up = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.agg(F.count_if(F.col("up") + F.col("down") > 1)).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """``node, component_id`` (the smallest node reachable) of all nodes of ``links`` (``a, b``, both long).

    Every round rewrites the links so that nodes point to smaller ones, until each points to the smallest of
    its component, which takes no round if they do from the start; rounds grow with the logarithm of a component's
    width, not with its size.  Each round is written out.  Links with a NULL end and self-links are ignored; an empty table gives no rows.
    """
    a, b = F.col("a"), F.col("b")
    edges = written(
        links.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    while not _settled(edges):
        # Large star: larger neighbours point to the smallest neighbour.
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        # Small star: smaller neighbours, and the node itself, point to the smallest one.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    found = edges.select(a.alias("node"), b.alias("component_id"))
    return found.unionByName(edges.select(b.alias("node"), b.alias("component_id")).distinct())
