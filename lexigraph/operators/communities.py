"""Communities of the link graph by modularity, in parallel and reproducibly.

Directed modularity of a division is the sum over communities of
in / m - out_degree * in_degree / m ** 2, with m the weight of all edges. As in
Louvain's method nodes move to the neighbouring community that gains most, and the
graph is contracted to one node for each community, level by level. Here all nodes
of a colour class move at once, each by what it gains where the others stand; the
two classes take turns and are drawn anew each pass, by a checksum of the node.

Rules, so that every run ends and gives the same: the gain of joining C is
m * w(node, C) - (out * in_degree(C) + in * out_degree(C)), with the node taken out
of its own community; equal gains go to the lesser community, and staying wins
against an equal one; a node alone joins another that is alone only if that one is
less. A pass that doesn't raise modularity by TOLERANCE ends its level, and is undone
where it lowered it; after PASSES passes a level ends too. The run ends when a level
moved nothing. A community is called by its least node.

Each pass reads and writes tables whose rows are the level's nodes and edges; what
comes to the driver is one row of sums. Weights of a node towards communities are
partial sums before they are shuffled, so that a hub is no hot key. Joins are merges:
a broadcast would bring a level's nodes to the driver in every pass.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

TOLERANCE, PASSES = 1e-4, 12
CLASSES = 2


def colour(node: Column, turn: int) -> Column:
    return F.crc32(F.concat(node.cast("string"), F.lit(f":{turn}")).cast("binary")) % CLASSES


def _merged(df: DataFrame) -> DataFrame:
    return df.hint("merge")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, kin, kout) of weighted edges (a, b, w)."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).cast("long").alias("kin"), F.col("w").alias("kout")).unionByName(edges.select(F.col("b").alias("node"), F.col("w").alias("kin"), F.lit(0).cast("long").alias("kout")))
    return ends.groupBy("node").agg(F.sum("kin").alias("kin"), F.sum("kout").alias("kout"))


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def modularity(edges: DataFrame, state: DataFrame) -> float:
    """Of edges (a, b, w) and state (node, comm, kin, kout). Sums are exact."""
    m = edges.agg(F.sum("w").alias("m")).first()["m"]
    if not m:
        return 0.0
    of = lambda end: state.select(F.col("node").alias(end), F.col("comm").alias(f"c{end}"))
    inside = edges.join(_merged(of("a")), "a").join(_merged(of("b")), "b").where("ca = cb").agg(F.sum("w").alias("inside"))
    totals = state.groupBy("comm").agg(F.sum("kin").alias("i"), F.sum("kout").alias("o")).agg(F.sum(_exact(F.col("i")) * _exact(F.col("o"))).alias("product"))
    row = inside.crossJoin(totals).first()  # one row each
    return float(Decimal(row["inside"] or 0) / m - Decimal(row["product"]) / (Decimal(m) * m))


def step(near: DataFrame, state: DataFrame, m: int, turn: int, klass: int) -> DataFrame:
    """state after the nodes of one colour class moved. near: (node, other, w) of
    both ways, w the sum of the two; state: (node, comm, kin, kout)."""
    totals = state.groupBy("comm").agg(F.sum("kin").alias("c_in"), F.sum("kout").alias("c_out"), F.count(F.lit(1)).alias("size"))
    movers = state.where(colour(F.col("node"), turn) == klass)
    towards = near.join(_merged(movers.select("node")), "node", "left_semi").join(_merged(state.select(F.col("node").alias("other"), "comm")), "other")
    towards = towards.groupBy("node", "comm").agg(F.sum("w").alias("w")).unionByName(movers.select("node", "comm", F.lit(0).cast("long").alias("w")))
    towards = towards.groupBy("node", "comm").agg(F.sum("w").alias("w")).join(_merged(movers.select("node", F.col("comm").alias("own"), "kin", "kout")), "node").join(_merged(totals), "comm")
    stays = F.col("comm") == F.col("own")
    rest_in, rest_out = F.col("c_in") - F.when(stays, F.col("kin")).otherwise(0), F.col("c_out") - F.when(stays, F.col("kout")).otherwise(0)
    d = lambda c: c.cast("double")
    gain = F.lit(float(m)) * d(F.col("w")) - (d(F.col("kout")) * d(rest_in) + d(F.col("kin")) * d(rest_out))
    options = towards.withColumn("gain", gain).withColumn("stays", stays)
    # The least of what is best: staying before moving, then the lesser community.
    best = F.min(F.struct((-F.col("gain")).alias("loss"), (~F.col("stays")).alias("moves"), "comm", "size"))
    chosen = options.groupBy("node", "own", "kin", "kout").agg(best.alias("best"), F.max(F.when(F.col("stays"), F.col("size"))).alias("own_size"))
    alone = (F.col("own_size") == 1) & (F.col("best.size") == 1) & (F.col("best.comm") > F.col("own"))
    moved = chosen.select("node", F.when(alone, F.col("own")).otherwise(F.col("best.comm")).alias("comm"), "kin", "kout")
    return state.where(colour(F.col("node"), turn) != klass).unionByName(moved)


def communities(links: DataFrame, nodes: DataFrame | None = None, tolerance: float = TOLERANCE, passes: int = PASSES) -> tuple[DataFrame, float]:
    """links (src, dst): each distinct pair counts once, loops don't. Returns (id,
    community) of every node of links and of nodes (id), and the modularity."""
    edges = links.where("src is not null and dst is not null and src != dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct().withColumn("w", F.lit(1).cast("long"))
    edges = first = materialise(edges, "community-edges")
    m = edges.count()
    everyone = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id")))
    everyone = (everyone if nodes is None else everyone.unionByName(nodes.select("id").where("id is not null"))).distinct()
    if not m:
        return everyone.withColumn("community", F.col("id")), 0.0
    labels, turn = None, 0
    quality = modularity(edges, degrees(edges).withColumn("comm", F.col("node")))
    while True:
        both = edges.where("a != b").select(F.col("a").alias("node"), F.col("b").alias("other"), "w")
        near = materialise(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"), "w")).groupBy("node", "other").agg(F.sum("w").alias("w")), "community-near")
        state = materialise(degrees(edges).select("node", F.col("node").alias("comm"), "kin", "kout"), "community-state")
        start = quality
        for _ in range(passes):
            before, q = state, quality
            for klass in range(CLASSES):
                state = materialise(step(near, state, m, turn, klass), "community-state")
            turn += 1
            quality = modularity(edges, state)
            if quality < q:
                state, quality = before, q
            if quality - q < tolerance:
                break
        level = state.select(F.col("node").alias("community"), F.col("comm").alias("next"))
        mine = level.select(F.col("community").alias("node"), "next") if labels is None else labels.join(_merged(level), "community").select("node", "next")
        labels = materialise(mine.withColumnRenamed("next", "community"), "community-labels")
        if quality <= start:
            break
        end = lambda c: state.select(F.col("node").alias(c), F.col("comm").alias(f"c{c}"))  # noqa: B023, E731
        edges = materialise(edges.join(_merged(end("a")), "a").join(_merged(end("b")), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "community-edges")
    names = labels.groupBy("community").agg(F.min("node").alias("least"))
    named = labels.join(_merged(names), "community").select(F.col("node").alias("id"), F.col("least").alias("community"))
    linked = first.select(F.col("a").alias("id")).unionByName(first.select(F.col("b").alias("id"))).distinct()
    alone = everyone.join(_merged(linked), "id", "left_anti")
    return named.unionByName(alone.withColumn("community", F.col("id"))), quality


def divided(links: DataFrame, division: DataFrame) -> DataFrame:
    """(links, inside, modularity): one row of how well a given division (id,
    community) fits links (src, dst), distinct and without loops."""
    edges = links.where("src != dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    of = lambda end: division.select(F.col("id").alias(end), F.col("community").alias(f"c{end}"))
    ends = edges.join(_merged(of("a")), "a").join(_merged(of("b")), "b").groupBy("ca", "cb").agg(F.count(F.lit(1)).alias("n"))
    out = ends.groupBy(F.col("ca").alias("c")).agg(F.sum("n").alias("o"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("n")).otherwise(0)).alias("inside"))
    into = ends.groupBy(F.col("cb").alias("c")).agg(F.sum("n").alias("i"))
    parts = out.join(_merged(into), "c", "full_outer").na.fill(0)
    sums = parts.agg(F.sum("o").alias("links"), F.sum("inside").alias("inside"), F.sum(_exact(F.col("o")) * _exact(F.col("i"))).cast("double").alias("product"))
    return sums.select("links", "inside", (F.col("inside") / F.col("links") - F.col("product") / (F.col("links").cast("double") * F.col("links"))).alias("modularity"))
