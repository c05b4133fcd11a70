"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import textops as X


def _rank(node: str) -> Column:
    """An order of the nodes that no chain of links can follow for long."""
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("n"))


def nearest(links: DataFrame) -> DataFrame:
    """(id, p): the end of two steps from each node to its least neighbour in hash order, or the node itself."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    step = both.groupBy("a").agg(F.min(_rank("b")).alias("m")).select(F.col("a").alias("id"), F.least(_rank("a"), F.col("m"))["n"].alias("p"))
    return step.join(step.select(F.col("id").alias("p"), F.col("p").alias("q")), "p").select("id", F.col("q").alias("p"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b) but links to itself; the component is its smallest id.

    Each round moves every node two steps towards its least neighbour and
    carries the links over: a node's link to that neighbour is itself a link,
    so what was connected stays so. Nodes are ordered by hash, so chains of
    steps are short and the nodes left fall by a factor each round. Minima are
    taken before the shuffle, so a node with very many links needs no task of
    its own. Tables are cut from their lineage by checkpoint().
    """
    scratch = X.Scratch(links.sparkSession)
    edges = X.cut(links.select("a", "b").where("a <> b"))
    labels = None
    while not edges.isEmpty():
        step = scratch.kept(nearest(edges))
        if labels is None:
            labels = step
        else:
            labels = X.cut(labels.join(step.select(F.col("id").alias("p"), F.col("p").alias("q")), "p", "left").select("id", F.coalesce("q", "p").alias("p")))
        a, b = (step.select(F.col("id").alias(c), F.col("p").alias(f"r{c}")) for c in "ab")
        moved = edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = X.cut(moved.distinct())
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = labels.groupBy("p").agg(F.min("id").alias("component"))
    out = X.cut(labels.join(least, "p").select("id", "component"))
    scratch.done()
    return out
