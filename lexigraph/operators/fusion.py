"""Fusion of lexical, vector and metadata scores to one score for each note.

Every part of a score is rounded to six places before the parts are summed, so
the parts shown add up to the score exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph
from .ranking import max_normalised, min_max

SNIPPET = "struct<chunk_id:bigint,strategy:string,heading_path:string,kind:string,text:string,score:double>"


def merge_passes(lexical: DataFrame, vector: DataFrame, text_weight: float, vector_weight: float) -> DataFrame:
    """(qid, chunk_id, text, vector, combined) of passages that either pass
    found (qid, doc, score). Lexical scores count by the query's largest."""
    lex = lexical.withColumn("text", max_normalised("score", "qid")).select("qid", F.col("doc").alias("chunk_id"), "text")
    vec = vector.select("qid", F.col("doc").alias("chunk_id"), F.col("score").alias("vector"))
    both = lex.join(vec, ["qid", "chunk_id"], "full_outer").select("qid", "chunk_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("text", "vector")])
    return both.withColumn("combined", F.lit(float(text_weight)) * F.col("text") + F.lit(float(vector_weight)) * F.col("vector"))


def reweighted(scored: DataFrame, text_weight: float, vector_weight: float) -> DataFrame:
    """Merged passes under other weights; a half without weight finds nothing."""
    text = F.col("text") if text_weight > 0 else F.lit(0.0)
    vector = F.col("vector") if vector_weight > 0 else F.lit(0.0)
    out = scored.select("qid", "chunk_id", text.alias("text"), vector.alias("vector")).where("text > 0 or vector > 0")
    return out.withColumn("combined", F.lit(float(text_weight)) * F.col("text") + F.lit(float(vector_weight)) * F.col("vector"))


def best_per_strategy(scored: DataFrame) -> DataFrame:
    """Adds scoring: whether a passage is the best of its note and strategy. Of
    equal ones the least id is."""
    w = W.partitionBy("qid", "note_id", "strategy").orderBy(F.round("combined", 9).desc(), "chunk_id")
    return scored.withColumn("scoring", F.row_number().over(w) == 1)


def snippets(scored: DataFrame, n: int) -> DataFrame:
    """(qid, note_id, snippets): each note's n best passages, equal texts once."""
    # By the texts' digests: texts that aren't asked for needn't move.
    once = W.partitionBy("qid", "note_id", F.sha2(F.trim("text_of"), 256)).orderBy(F.round("combined", 9).desc(), "chunk_id")
    by = W.partitionBy("qid", "note_id").orderBy(F.round("combined", 9).desc(), "chunk_id")
    rows = scored.withColumn("k", F.row_number().over(once)).where("k = 1").withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)
    one = F.struct("chunk_id", "strategy", F.nullif("heading_path", F.lit("")).alias("heading_path"), "kind", F.col("text_of").alias("text"), F.round("combined", 6).alias("score"))
    return rows.groupBy("qid", "note_id").agg(F.array_sort(F.collect_list(F.struct("place", one.alias("s")))).alias("ss")).select("qid", "note_id", F.transform("ss", lambda x: x["s"]).alias("snippets"))


def fuse(scored: DataFrame, chunks: DataFrame, meta: DataFrame, notes: DataFrame, config: dict, weights: tuple[float, float], n_snippets: int = 2) -> DataFrame:
    """scored (qid, chunk_id, text, vector, combined), chunks (id, note_id,
    strategy, heading_path, kind, text), meta (qid, doc, score), notes (id, title,
    status). Returns hits (qid, id, title, score, why, snippets) of active notes
    with a positive score."""
    s = config["search"]
    about = chunks.select(F.col("id").alias("chunk_id"), "note_id", "strategy", "heading_path", "kind", F.col("text").alias("text_of"))
    placed = best_per_strategy(scored.join(about, "chunk_id"))
    share = F.when(F.col("strategy") == "fine", float(s["strategyWeights"]["fine"])).otherwise(float(s["strategyWeights"]["coarse"]))
    best = F.col("scoring").cast("double") * share
    top = F.max_by("strategy", F.when(F.col("scoring"), F.struct(F.round("combined", 9), -F.col("chunk_id"))))
    by_note = placed.groupBy("qid", "note_id").agg(
        F.sum(best * F.lit(weights[0]) * F.col("text")).alias("text"), F.sum(best * F.lit(weights[1]) * F.col("vector")).alias("vector"), F.count(F.lit(1)).alias("matched"), top.alias("best_strategy")
    )
    named = meta.withColumn("meta", max_normalised("score", "qid")).select("qid", F.col("doc").alias("note_id"), "meta")
    both = by_note.join(named, ["qid", "note_id"], "full_outer")
    active = notes.where("status = 'active'").select(F.col("id").alias("note_id"), "title")
    chunk, lam = float(s["fusion"]["chunk"]), float(s["fusion"]["lambdaMultiChunk"])
    z = lambda c: F.coalesce(c, F.lit(0.0))
    matched = F.coalesce("matched", F.lit(0))
    why = F.struct(
        F.round(chunk * z("text"), 6).alias("text"),
        F.round(chunk * z("vector"), 6).alias("vector"),
        F.round(float(s["fusion"]["meta"]) * z("meta"), 6).alias("meta"),
        F.lit(0.0).alias("graph"),
        F.round(chunk * F.when(matched > 0, lam * F.log(1.0 + matched)).otherwise(0.0), 6).alias("multi_chunk"),
        F.coalesce("best_strategy", F.lit("")).alias("best_strategy"),
        matched.alias("matched_chunks"),
    )
    hits = both.join(active, "note_id").select("qid", F.col("note_id").alias("id"), "title", why.alias("why"))
    hits = hits.withColumn("score", F.col("why.text") + F.col("why.vector") + F.col("why.meta") + F.col("why.multi_chunk")).where("score > 0")
    shown = snippets(placed, n_snippets).withColumnRenamed("note_id", "id")
    out = hits.join(shown, ["qid", "id"], "left")
    return out.select("qid", "id", "title", "score", "why", F.coalesce("snippets", F.array().cast(f"array<{SNIPPET}>")).alias("snippets"))


def apply_graph(hits: DataFrame, edges: DataFrame, notes: DataFrame, config: dict, once: bool = False) -> DataFrame:
    """hits with their neighbours' boosts, and the notes that several link with."""
    g = config["search"]["graph"]
    if g["boost"] <= 0 and g["expandDepth"] <= 0:
        return hits.withColumn("via", F.lit(None).cast("array<string>"))
    boosts, extra = graph.adjust(hits.select("qid", "id", "score"), edges, g["boost"], g["expandDepth"] > 0, g["expandMinVotes"], once)
    up = F.coalesce("boost", F.lit(0.0))
    why = F.col("why").withField("graph", F.round(up, 6))
    boosted = hits.join(boosts, ["qid", "id"], "left").select("qid", "id", "title", (F.col("score") + up).alias("score"), why.alias("why"), "snippets", F.lit(None).cast("array<string>").alias("via"))
    active = notes.where("status = 'active'").select("id", "title")
    bare = F.struct(*[F.lit(0.0).alias(x) for x in ("text", "vector", "meta")], F.round("score", 6).alias("graph"), F.lit(0.0).alias("multi_chunk"), F.lit("").alias("best_strategy"), F.lit(0).cast("long").alias("matched_chunks"))
    added = extra.join(active, "id").select("qid", "id", "title", "score", bare.alias("why"), F.array().cast(f"array<{SNIPPET}>").alias("snippets"), F.col("via").cast("array<string>").alias("via"))
    return boosted.unionByName(added)


def finish(hits: DataFrame, k: int) -> DataFrame:
    """Each query's k best, scores rounded, with ranks; ties by id."""
    w = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", F.round("score", 6))


def heat(hits: DataFrame) -> DataFrame:
    return hits.withColumn("heat", min_max("score", "qid"))
