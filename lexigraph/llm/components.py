"""Connected components of an undirected graph by alternating stars.

Every round replaces the edges of each node by edges to its least neighbour,
first for larger neighbours, then for smaller ones, until all that is left are
stars around each component's least node. Each round is written to the shared
folder. Rows of one hot node are counted with partial aggregates, not gathered;
the join that brings a hot node's least neighbour to its edges has a written
table on either side, so that Spark can split the hot node's rows among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, estimated_bytes, materialise


def _nodes(edges: DataFrame) -> DataFrame:
    """Of (u, v), u > v: each node n with its least neighbour m, how many edges
    lead down from it, and whether one leads up."""
    ends = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
    return ends.groupBy("n").agg(F.min("o").alias("m"), F.count_if(F.col("o") < F.col("n")).alias("down"), F.max(F.col("o") > F.col("n")).alias("up"))


def _large(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge's larger end, and the least that its smaller end has or is."""
    least = nodes.select(F.col("n").alias("v"), F.least("m", "n").alias("m"))
    return edges.join(least, "v").select("u", F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, led to the least of them. Both sides
    of the join are dealt by u already."""
    m = edges.groupBy("u").agg(F.min("v").alias("m"))
    to = edges.join(m.hint("merge"), "u")
    return to.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(to.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, size: int | None = None) -> DataFrame:
    """edges (u, v) of longs, of about size bytes. Returns (node, component) of every
    node with an edge to another one; the component is its least node. Edges are stars once
    no node has two edges down, nor one down and one up. A round's tables go
    once the next one is written."""
    now = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", size)
    while True:
        size = 4 * estimated_bytes(now)  # of any table of a round: there are no more edges in the next one
        nodes = materialise(_nodes(now), "nodes", size)
        if nodes.where("down > 1 or (down = 1 and up)").isEmpty():
            drop(nodes)
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, now = now, materialise(_small(_large(now, nodes)), "stars", size)
        drop(before)
        drop(nodes)
