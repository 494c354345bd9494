"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import settle, sweeping


def components(links: DataFrame, folder: str) -> DataFrame:
    """``a``, ``b`` -> ``node``, ``root`` (the smallest node of its component).

    Every round links each node to the smallest neighbour it sees, first from its larger
    and then from its smaller neighbours, which flattens a chain in a logarithmic number
    of rounds. Neighbours are never gathered: a round takes minima (combined before the
    shuffle) and joins them back, so a hub costs no more than its links. Rounds end when
    all links lead to roots; each is written to the shared folder.
    """
    edges = settle(_ordered(links), folder, "links")
    while not _flat(edges):
        edges = settle(_small_star(_large_star(edges)), folder, "links")
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root"))
    )


def merged(roots: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """Components after further links: their roots are joined, other nodes follow."""
    ends = links
    for end in ("a", "b"):
        root = roots.select(F.col("node").alias(end), F.col("root").alias("r"))
        ends = ends.join(root, end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
    up = settle(components(ends, folder), folder, "up")
    new = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(new, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = up.join(roots.select("node"), "node", "left_anti")
    return settle(moved.unionByName(fresh), folder, "roots")


def _flat(edges: DataFrame) -> bool:
    """Whether each node has one link, and no link leads to a node that has one."""
    ends = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    degree = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    with sweeping(edges.sparkSession):
        return degree.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty()


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller."""
    return (
        links.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    joined = both.join(least, "a").where("b > a")
    return _ordered(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(joined.unionByName(least.select("a", F.col("m").alias("b"))))
