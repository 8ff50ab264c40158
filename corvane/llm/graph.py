"""Connected components by alternating large-star and small-star steps over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.work import Workspace

#: Nodes, of 16 bytes each, that may be broadcast.
FEW = 1_000_000


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether each larger end has one link and is no smaller end."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("links"), F.lit(0).alias("root"))
    ends = ends.unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("links"), F.lit(1).alias("root")))
    return not ends.groupBy("n").agg(F.sum("links").alias("links"), F.max("root").alias("root")).where("links + root > 1").agg(F.count("*")).first()[0]


def relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """``labels`` (node, component) after components are merged; those of ``merged`` that had no label are their own."""
    moved = labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    fresh = merged.join(labels.select("node"), "node", "left_anti")
    return moved.select("node", F.coalesce("root", "component").alias("component")).unionByName(fresh.select("node", "component"))


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component) for each node that has a link; component: the smallest node reachable.

    A round keeps the number of links within the number of nodes and links, and is written as a table, so nothing of
    the graph is ever on the driver and a lost executor costs one round. Rounds grow with the logarithm of the size and
    end when the links are a forest of stars.
    """
    edges, turn = work.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0"), 0
    while not _stars(edges):
        both = _both(edges)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        if few := edges.count() <= FEW // 2:  # a row per node: then no centre of a star is one task's load
            least = F.broadcast(least)
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(F.broadcast(least) if few else least, F.col("a") == F.col("n"))
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        turn += 1
        edges = work.save(small, f"{name}{turn}")
        work.drop(f"{name}{turn - 1}")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
