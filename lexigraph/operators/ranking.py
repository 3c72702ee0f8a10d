"""Ranks, cuts and normalisation, batched by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, key: str, score: str, tie: str, k: int, digits: int = 9) -> DataFrame:
    """The k best of each key, best first, ties by tie; adds rank. Each task
    passes on no more than k rows of a key. Scores that differ in the last
    binary digits only, from another order of summing, count as ties."""
    w = W.partitionBy(key).orderBy(F.round(score, digits).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def max_normalised(score: str, key: str) -> Column:
    """score by the largest of its key; 0 where that isn't positive."""
    most = F.max(score).over(W.partitionBy(key))
    return F.when(most > 0, F.col(score) / most).otherwise(0.0)


def min_max(score: str, key: str) -> Column:
    """score between its key's least and largest; 1 where they are equal."""
    w = W.partitionBy(key)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(1.0)


def row_numbers(df: DataFrame, order: str, name: str, part_rows: int = 250_000) -> DataFrame:
    """df with a number from 1 in the order of a column, without one task that
    sees all rows: rows are dealt to ranges of the order, counted, numbered
    within their range, and the counts of the ranges before are added. There are
    64 ranges, or as many of part_rows as hold all rows, 1,024 at most."""
    # Cuts come from a sample of about 30 values for each: they decide who counts what, not the numbers.
    n = df.count()
    parts = min(1024, max(64, n // part_rows))
    seen = sorted({r[0] for r in df.select(order).where(F.col(order).isNotNull()).sample(min(1.0, 30.0 * parts / max(n, 1)), seed=1).collect()})
    at = seen[:: max(1, len(seen) // parts)]
    ranged = df.withColumn("__range", F.size(F.filter(F.array(*[F.lit(c) for c in at]), lambda c: c < F.col(order))) if at else F.lit(0))
    counts = ranged.groupBy("__range").count()
    offsets = counts.select(F.col("__range").alias("__at"), (F.sum("count").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).alias("__before"))
    numbered = ranged.withColumn("__local", F.row_number().over(W.partitionBy("__range").orderBy(order)))
    joined = numbered.join(offsets, numbered["__range"].eqNullSafe(offsets["__at"]))
    return joined.withColumn(name, F.col("__before") + F.col("__local")).drop("__range", "__at", "__before", "__local")


def every_nth(df: DataFrame, order: str, stride: int) -> DataFrame:
    """Adds held_out: every stride-th row in an order. For query sets."""
    return row_numbers(df, order, "position").withColumn("held_out", F.col("position") % stride == 0)


def holdout_stride(n: int, fraction: float) -> int | None:
    """How far apart held-out queries are; None: none are held out."""
    if fraction <= 0 or n < 4:
        return None
    return max(2, int(1 / min(fraction, 0.5) + 0.5))


def rank_of(value: str, key: str, tie: str) -> Column:
    """The place of a value within its key, larger first; ties by tie, each with
    a place of its own."""
    return F.row_number().over(W.partitionBy(key).orderBy(F.round(value, 9).desc(), tie))


def reciprocal_rank_fusion(df: DataFrame, key: str, signals: list[str], tie: str, k: int = 60) -> DataFrame:
    """Adds rrf: the sum of 1 / (k + rank) over the signals, larger first."""
    for s in signals:
        df = df.withColumn(f"__{s}", rank_of(s, key, tie))
    total = sum((1.0 / (F.lit(float(k)) + F.col(f"__{s}")) for s in signals[1:]), 1.0 / (F.lit(float(k)) + F.col(f"__{signals[0]}")))
    return df.withColumn("rrf", total).drop(*[f"__{s}" for s in signals])
