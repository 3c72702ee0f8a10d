"""Retrieval metrics of ranked answers, batched by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gain(rank: Column) -> Column:
    """The discount of a rank that starts at 1."""
    return 1 / F.log2(rank + 1.0)


def per_query(golden: DataFrame, hits: DataFrame, recall_k: int = 5, ndcg_k: int = 10) -> DataFrame:
    """golden (qid, relevant, irrelevant arrays), hits (qid, id, rank). Returns
    recall, mrr and ndcg, null where nothing is relevant, and negatives."""
    rel = golden.select("qid", F.explode("relevant").alias("id"), F.lit(1).alias("good"))
    bad = golden.select("qid", F.explode("irrelevant").alias("id"), F.lit(0).alias("good"))
    judged = hits.join(rel.distinct().unionByName(bad.distinct()), ["qid", "id"])
    is_good, rank = F.col("good") == 1, F.col("rank")
    sums = judged.groupBy("qid").agg(
        F.count_if(is_good & (rank <= recall_k)).alias("found"), F.min(F.when(is_good, rank)).alias("first"), F.sum(F.when(is_good & (rank <= ndcg_k), gain(rank)).otherwise(0.0)).alias("dcg"), F.count_if(~is_good & (rank <= ndcg_k)).alias("negatives")
    )
    n = F.size("relevant")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(ndcg_k), F.greatest(F.size(F.array_distinct("relevant")), F.lit(1)))), F.lit(0.0), lambda a, i: a + gain(i))
    z = lambda c: F.coalesce(c, F.lit(0))
    return golden.join(sums, "qid", "left").select(
        "qid", F.when(n > 0, z("found") / n).alias("recall"), F.when(n > 0, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.when(n > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), z("negatives").alias("negatives")
    )


def means(rows: DataFrame, *by: str) -> DataFrame:
    """Means over the queries that have a value; 0 if none has."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("recall", "mrr", "ndcg")], F.sum("negatives").alias("negatives"))


def percentile(column: str, fraction: float) -> Column:
    """Nearest-rank percentile of a sample."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY `{column}`)")


def unknown_ids(golden: DataFrame, notes: DataFrame) -> DataFrame:
    """Ids that a golden set names and no note has."""
    named = golden.select(F.explode(F.concat("relevant", "irrelevant")).alias("id")).distinct()
    return named.join(notes.select("id"), "id", "left_anti")
