"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelight.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select("b", "a")).distinct()
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, both.a == least.node).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    handed = down.join(least, down.a == least.node).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.union(least.select("node", "m")).where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node
    reachable. Neighbours are never collected, so a node may have any number."""
    edges = scratch.write(links.select("a", "b").where("a <> b").distinct(), f"{name}-0")
    seen, turn = None, 0
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark.n:
            break
        seen, turn = mark, turn + 1
        edges = scratch.write(_small_star(_large_star(edges)), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
