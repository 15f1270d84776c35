"""Connected components of a link table, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm import common as C


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes of the links (u, v).

    Every round merges each node into the end of the way over smallest neighbours, and keeps only
    the links that still join different nodes, so later rounds are small; each is written to the
    shared folder. It ends when no link is left.
    """
    spark = links.sparkSession
    edges = C.cut(_both_ways(links), "cc-edges")
    label = None
    while True:
        merged = _roots(C.cut(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("component")), "cc-low"))
        if label is None:
            label = merged
        else:
            further = merged.select(F.col("node").alias("component"), F.col("component").alias("next"))
            new = C.cut(label.join(further, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "cc-labels")
            C.drop_cut(spark, label)
            label = new
        side = lambda x: merged.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        # one direction of each link is enough to find the links that are left
        left = edges.where("u < v").join(side("u"), "u").join(side("v"), "v").select(F.col("c_u").alias("u"), F.col("c_v").alias("v"))
        rest = C.cut(_both_ways(left), "cc-edges")
        C.drop_cut(spark, edges)
        if merged is not label:
            C.drop_cut(spark, merged)
        edges = rest
        if not edges.limit(1).count():
            C.drop_cut(spark, edges)
            return label


def _roots(low: DataFrame) -> DataFrame:
    """The end of every node's way along (node, component); each step doubles the ways."""
    while True:
        step = low.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = C.cut(low.join(step, "component").select("node", F.col("next").alias("component"), (F.col("next") < F.col("component")).alias("moved")), "cc-roots")
        moved = new.where("moved").limit(1).count()
        C.drop_cut(low.sparkSession, low)
        low = new.select("node", "component")
        if not moved:
            return low


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
