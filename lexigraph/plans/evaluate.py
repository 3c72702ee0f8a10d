"""Evaluation of a golden set, and tuning of weights: one job for all queries,
and one for all trials, since what the passes find doesn't depend on weights."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, apply_patch, read, resolve_weights
from ..operators import fusion, lexical, metrics
from ..operators.ranking import every_nth, holdout_stride
from ..storage import materialise
from . import search as S

#: The knobs that tuning turns, and between what.
KNOBS = {
    "search.hybridWeights.text": (0, 1),
    "search.hybridWeights.vector": (0, 1),
    "search.strategyWeights.fine": (0.2, 1.5),
    "search.strategyWeights.coarse": (0.2, 1.5),
    "search.fusion.chunk": (0.3, 1),
    "search.fusion.meta": (0, 0.7),
    "search.fusion.lambdaMultiChunk": (0, 0.4),
    "search.graph.boost": (0, 0.4),
    "search.boost.title": (1, 5),
}
SMALL_SET = 20


def run(index: S.SearchIndex, golden: DataFrame, config: dict | None = None, mode: str = "hybrid", recall_k: int = 5, ndcg_k: int = 10) -> DataFrame:
    """(qid, recall, mrr, ndcg, negatives) of every query of a golden set."""
    hits = S.search(index, golden.select("qid", "q"), config, mode, k=max(recall_k, ndcg_k))
    return metrics.per_query(golden, hits.select("qid", F.col("id"), "rank"), recall_k, ndcg_k)


def warning(golden: DataFrame) -> str | None:
    n = golden.count()
    return f"{n} queries are few: their means may be luck" if n < SMALL_SET else None


def trials(config: dict, n: int, seed: int) -> list[dict[str, float]]:
    """Random settings of all knobs to two places; none without any weight."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        patch = {path: round(lo + rng.random() * (hi - lo), 2) for path, (lo, hi) in KNOBS.items()}
        if patch["search.hybridWeights.text"] + patch["search.hybridWeights.vector"] > 0:
            out.append(patch)
    return out


def split(golden: DataFrame, fraction: float = 0.5) -> tuple[DataFrame, DataFrame | None]:
    """Queries to search on, and every n-th of them held out."""
    stride = holdout_stride(golden.count(), fraction)
    if stride is None:
        return golden, None
    marked = every_nth(golden, "qid", stride)
    return marked.where("not held_out").drop("position", "held_out"), marked.where("held_out").drop("position", "held_out")


def changes(config: dict, patch: dict[str, float]) -> list[dict]:
    """What a patch changes, in order of the paths."""
    return [{"path": p, "from": read(config, p), "to": v} for p, v in sorted(patch.items()) if read(config, p) != v]


def tune(index: S.SearchIndex, golden: DataFrame, config: dict | None = None, n: int = 60, objective: str = "ndcg", seed: int = 1, fraction: float = 0.5, together: int = 8) -> dict:
    """The best of n random settings on the searched half, and what both it and
    the settings at hand score on the held-out half.

    Both passes and the metadata matches are made once and written: no knob
    changes what they find. Trials only rank them, `together` in one job, with
    one row for each trial sent to the driver.
    """
    config = config or DEFAULTS
    part, held = split(golden, fraction)
    patches = [{}, *trials(config, n, seed)]
    queries = S.check_gate(golden.select("qid", "q"))
    scored = materialise(S.retrieve(index, queries, config, (1.0, 1.0)), "tune-passes")
    named = materialise(lexical.matches(queries, index.note_words, S.tolerance_of(config, None), require_all=True), "tune-names")

    def means(on: DataFrame, which: list[int]) -> dict[int, float]:
        out, ids = None, on.select("qid")
        mine = scored.join(ids, "qid", "left_semi"), named.join(ids, "qid", "left_semi")
        for i in which:
            c = apply_patch(config, patches[i])
            w = resolve_weights(c, "hybrid")
            hits = S.rank(index, fusion.reweighted(mine[0], *w), mine[1], c, w)
            rows = metrics.per_query(on, hits.select("qid", "id", "rank")).withColumn("trial", F.lit(i))
            out = rows if out is None else out.unionByName(rows)
        return {r["trial"]: r[objective] for r in metrics.means(out, "trial").collect()}

    scores: dict[int, float] = {}
    for i in range(0, len(patches), together):
        scores |= means(part, list(range(i, min(len(patches), i + together))))
    best = max(scores, key=lambda i: (scores[i], -i))
    changed = changes(config, patches[best])
    out = {"objective": objective, "trials": n, "baseline": scores[0], "best": scores[best], "changes": changed, "holdout": None, "improved": scores[best] > scores[0]}
    if held is not None and best:
        on_held = means(held, [0, best])
        out |= {"holdout": {"baseline": on_held[0], "best": on_held[best]}, "improved": on_held[best] > on_held[0]}
    return out


def log_run(runs: DataFrame, result: DataFrame, latencies_ms: list[float], config_json: str, note: str | None = None, recall_k: int = 5, ndcg_k: int = 10, space: str | None = None) -> DataFrame:
    """runs with a row more: the means, and the latencies' percentiles."""
    spark = runs.sparkSession
    m = metrics.means(result).first()
    lat = spark.createDataFrame([(float(x),) for x in latencies_ms] or [(0.0,)], "ms double").agg(metrics.percentile("ms", 0.5).alias("p50"), metrics.percentile("ms", 0.95).alias("p95")).first()
    last = runs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    names = "id long, space_id string, queries int, recall_k int, ndcg_k int, recall double, mrr double, ndcg double, p50_ms int, p95_ms int, config string, metrics string, note string"
    row = (last + 1, space, m["queries"], recall_k, ndcg_k, m["recall"], m["mrr"], m["ndcg"], round(lat["p50"]), round(lat["p95"]), config_json, None, note)
    return runs.unionByName(spark.createDataFrame([row], names).withColumn("created_at", F.current_timestamp()).withColumn("metrics", F.to_json(F.struct("recall", "mrr", "ndcg"))))


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
