"""The link graph: adjacency, neighbours, boosts, expansion, traversal, export.

Edges are (src, dst, resolved); a walk goes either way along them. Sums over a
node's neighbours are partial aggregates and joins on node ids, which adaptive
execution splits where a node has very many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

#: Levels of a walk after which what was seen is put in one table.
LEVELS = 16


def adjacency(links: DataFrame) -> DataFrame:
    """Distinct resolved edges without loops."""
    return links.where("resolved and src != dst").select("src", "dst").distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """(a, b) for each pair of neighbours, both ways round, once."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def outgoing(links: DataFrame, node) -> DataFrame:
    return links.where(F.col("src") == node).orderBy("dst", "anchor")


def incoming(links: DataFrame, node) -> DataFrame:
    return links.where((F.col("dst") == node) & F.col("resolved")).orderBy("src", "anchor")


def dangling(links: DataFrame) -> DataFrame:
    return links.where("not resolved")


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree): distinct neighbours, whichever way the link goes."""
    return symmetric(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def neighbours(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, neighbour, relation) of active neighbours: links, backlinks, both."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), F.lit(1).alias("way"))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), F.lit(2).alias("way"))
    ways = out.unionByName(back).groupBy("id", "neighbour").agg(F.bit_or("way").alias("ways"))
    active = notes.where("status = 'active'").select(F.col("id").alias("neighbour"))
    named = F.when(F.col("ways") == 3, "both").when(F.col("ways") == 1, "links").otherwise("backlinks")
    return ways.join(active, "neighbour", "left_semi").select("id", "neighbour", named.alias("relation"))


def attach_neighbours(hits: DataFrame, edges: DataFrame, notes: DataFrame) -> DataFrame:
    """hits (id, ...) with neighbours, a list in order of id; empty without any.
    Taken after the cut, so only the hits' lists are gathered."""
    near = neighbours(edges, notes).join(hits.select("id").distinct(), "id", "left_semi")
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("neighbour", "relation"))).alias("neighbours"))
    out = hits.join(lists, "id", "left")
    return out.withColumn("neighbours", F.coalesce("neighbours", F.array().cast(dict(lists.dtypes)["neighbours"])))


def orphans(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Active notes without a resolved link from or to another."""
    active = notes.where("status = 'active'").select("id")
    ends = links.where("resolved")
    no_out = active.join(ends.select(F.col("src").alias("id")), "id", "left_anti")
    return no_out.join(ends.select(F.col("dst").alias("id")), "id", "left_anti")


def adjust(hits: DataFrame, edges: DataFrame, boost: float, expand: bool = True, min_votes: int = 2, both: bool = False) -> tuple[DataFrame, DataFrame]:
    """For hits (qid, id, score): boosts (qid, id, boost) of hits whose neighbours
    are hits too, and expansions (qid, id, score, via) that enough hits link with.

    A hit's boost is boost x the sum of its neighbours' scores / its degree,
    counting neighbours that are no hits; an expansion's score is boost x the
    mean of its voters'. With both, what the two are made from is written once.
    """
    near = symmetric(edges)
    reached = hits.join(near, hits["id"] == near["a"]).select("qid", F.col("a").alias("voter"), F.col("b").alias("id"), "score")
    mine = hits.select("qid", "id", F.lit(True).alias("is_hit"))
    marked = reached.join(mine, ["qid", "id"], "left").withColumn("is_hit", F.coalesce("is_hit", F.lit(False)))
    if both:
        marked = materialise(marked, "graph-votes")
    sums = marked.where("is_hit").groupBy("qid", "id").agg(F.sum("score").alias("around")).where("around > 0")
    deg = degree(edges).withColumnRenamed("node", "id")
    boosts = sums.join(deg, "id").select("qid", "id", (F.lit(float(boost)) * F.col("around") / F.greatest(F.lit(1), F.col("degree"))).alias("boost"))
    if boost <= 0:
        boosts = boosts.limit(0)
    votes = marked.where("not is_hit").groupBy("qid", "id").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("voter")).alias("via"))
    expansions = votes.where(F.col("n") >= min_votes).select("qid", "id", (F.lit(float(boost)) * F.col("mean")).alias("score"), "via")
    return boosts, expansions if expand else expansions.limit(0)


def traverse(origins: DataFrame, edges: DataFrame, notes: DataFrame, depth: int | None) -> DataFrame:
    """Breadth-first from each origin (qid, id): (qid, id, distance, via) of the
    active notes within depth, or with None all that can be reached; via is the
    note before, the first one reached and among those of one distance the least.
    Notes that aren't active are seen but neither returned nor walked on from.

    Each level is written once and made from the level before alone: its edges, less
    what any level has seen. The walk ends at a level with nothing new."""
    near = materialise(symmetric(edges), "walk-edges")
    active = notes.where("status = 'active'").select("id")
    seen, front, found = origins.select("qid", "id"), origins.select("qid", "id", F.array("id").alias("path")), []
    distance = 0
    while depth is None or distance < depth:
        distance += 1
        # The order of arrival: that of the notes before, then the ids'. It is carried as the path.
        step = front.join(near, front["id"] == near["a"]).select("qid", F.col("b").alias("id"), F.col("id").alias("via"), "path")
        new = step.join(seen, ["qid", "id"], "left_anti").groupBy("qid", "id").agg(F.min_by("via", "path").alias("via"), F.min("path").alias("path"))
        new = materialise(new.join(active.withColumn("walks", F.lit(True)), "id", "left").select("qid", "id", "via", "path", F.coalesce("walks", F.lit(False)).alias("walks")), "walk-level")
        seen = seen.unionByName(new.select("qid", "id"))
        if distance % LEVELS == 0:
            seen = materialise(seen, "walk-seen")
        front = new.where("walks").select("qid", "id", F.concat("path", F.array("id")).alias("path"))
        found.append(new.where("walks").select("qid", "id", F.lit(distance).alias("distance"), "via"))
        if depth is None and front.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def walk_scores(steps: DataFrame) -> DataFrame:
    """Traversal as hits: the score falls with distance."""
    return steps.withColumn("score", F.lit(1.0) / (1 + F.col("distance")))


def export_nodes(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes of the graph view: notes with links out + in, and phantoms, which
    are targets that no note has."""
    ends = links.where("resolved and src != dst").select("src", "dst").distinct()
    counts = ends.select(F.col("src").alias("id")).unionByName(ends.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    real = notes.join(counts, "id", "left").select(F.col("id").cast("string").alias("id"), F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(False).alias("phantom"))
    missing = dangling(links).select("src", "dst").distinct().groupBy(F.col("dst").cast("string").alias("id")).agg(F.count(F.lit(1)).alias("degree")).withColumn("phantom", F.lit(True))
    return real.unionByName(missing)


def merge_layout(stored: DataFrame, local: DataFrame) -> DataFrame:
    """Positions (note_id, x, y, pending): pending local ones win over stored."""
    l = local.select("note_id", F.col("x").alias("lx"), F.col("y").alias("ly"), "pending")  # noqa: E741
    both = stored.select("note_id", "x", "y").join(l, "note_id", "full_outer")
    mine = F.coalesce("pending", F.lit(False)) | F.col("x").isNull()
    return both.select("note_id", F.when(mine, F.col("lx")).otherwise(F.col("x")).alias("x"), F.when(mine, F.col("ly")).otherwise(F.col("y")).alias("y"))


def save_layout(stored: DataFrame, moved: DataFrame, notes: DataFrame) -> DataFrame:
    """stored (note_id, x, y, updated_at) with what moved (note_id, x, y): only
    finite positions of notes that there are."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    known = moved.where(finite("x") & finite("y")).dropDuplicates(["note_id"]).join(notes.select(F.col("id").alias("note_id")), "note_id", "left_semi")
    kept = stored.join(known.select("note_id"), "note_id", "left_anti")
    return kept.unionByName(known.select("note_id", "x", "y", F.current_timestamp().alias("updated_at")))


def clear_layout(stored: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Without the positions of gone (note_id); of all notes if gone is None."""
    return stored.limit(0) if gone is None else stored.join(gone.select("note_id"), "note_id", "left_anti")


def list_layout(stored: DataFrame) -> DataFrame:
    return stored.select("note_id", "x", "y").orderBy("note_id")


def read_layout(stored: DataFrame, note_id) -> DataFrame:
    return stored.where(F.col("note_id") == note_id).select("note_id", "x", "y")
