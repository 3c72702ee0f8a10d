"""Terms scored within a note's row: the same as by joins of words, none of them moved."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.functions import embedding
from lexigraph.functions import text as T
from lexigraph.operators import terms as M
from lexigraph.operators import vectors as V


@pytest.fixture(scope="module")
def notes(spark):
    body = "The Fast indexer reads large files. ```\nfenced code words\n```\n\nA graph database. IO and HTTP servers write-ahead logs."
    rows = [(i, " ".join([body, f"Note {i} has a stable marker{i % 3}."] * (1 + i % 4))) for i in range(70)] + [(70, None), (71, ""), (72, "the of.")]
    return spark.createDataFrame(rows, "id long, body string").repartition(3)


def test_costs_within_the_row(notes):
    rows = lambda df: {(r.note_id, r.lemma): (r.position, r.text, r.kind, r["count"], r.occurrences, round(r.yake, 12)) for r in df.collect()}
    got = M.costed_candidates(notes)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(M.phrase_costs(M.candidates(notes), M.yake(M.word_stats(notes, spread=True)))) != {}


def test_scored_terms_move_no_words(spark, sf_dir):
    from lexigraph.catalogue import term_queries as Q

    plan = Q.scored_terms(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "collect_list(struct(at" not in plan


def test_selection_in_arrow_batches(spark):
    rows = [(n, f"a{i} b", "phrase" if i % 3 else "keyword", (i * 7 % 5) / 5) for n in range(600) for i in range(4)] + [(None, "x", "keyword", 1.0)]
    scored = spark.createDataFrame(rows, "note_id long, lemma string, kind string, score double")
    got = M.select_terms(scored, 1, 2)
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString() and got.schema == scored.schema
    found = got.collect()
    assert len(found) == 600 * 3 + 1 and {(r.lemma, r.kind) for r in found if r.note_id == 5} == {("a3 b", "keyword"), ("a2 b", "phrase"), ("a1 b", "phrase")} | set()


def test_lemmas_vectors_are_not_moved(spark):
    model = embedding.find_model("hashing-64")
    pool = spark.createDataFrame([(n, f"lemma {i}", f"Lemma {i}{'s' * (n % 2)}", 0.5) for n in range(9) for i in range(4)], "note_id long, lemma string, text string, score double")
    means = spark.createDataFrame([(n, f"lemma {n}") for n in range(7)] + [(7, "")], "note_id long, t string").select("note_id", embedding.embed(F.col("t"), model).cast("array<double>").alias("vec"))
    got = M.embedding_scores(pool, means, model)
    assert got.columns == [*pool.columns, "embedding"]
    texts = pool.groupBy("lemma").agg(F.min("text").alias("t")).withColumn("v", embedding.embed(F.col("t"), model))
    want = pool.join(texts, "lemma").join(means, "note_id", "left").select("note_id", "lemma", F.when(F.col("vec").isNotNull(), T.cosine(F.col("v"), F.col("vec"))).otherwise(0.0).alias("e"))
    assert {(r.note_id, r.lemma): round(r.embedding, 9) for r in got.collect()} == {(r.note_id, r.lemma): round(r.e, 9) for r in want.collect()}
    assert "cosine" not in got._jdf.queryExecution().executedPlan().toString()


def test_mean_vectors_in_pieces(spark):
    rows = [("a", [3.0, 0.0]), ("a", [0.0, 4.0]), ("a", None), ("b", [1.0, None, 2.0]), ("b", [1.0]), (None, [0.0, 2.0]), ("c", None), ("d", []), ("z", [0.0, 0.0])]
    df = spark.createDataFrame(rows * 3, "k string, vec array<double>").repartition(5)
    found = V.mean_vectors(df, "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    got = {r.k: [None if x is None else round(x, 9) for x in r.vec] for r in found.collect()}
    assert got == {"a": [0.6, 0.8], "b": [round(2**-0.5, 9), None, round(2**-0.5, 9)], None: [0.0, 1.0], "z": [0.0, 0.0]}


def test_scored_within_the_row(spark, notes):
    """as by joins and windows, and candidates meet no exchange or window."""
    tagged = notes.select("id", F.concat(F.lit("Graph notes of "), F.col("id")).alias("title"), "body", F.when(F.col("id") % 2 == 0, "database").alias("tag"))
    anchors = spark.createDataFrame([(1, ["A graph database", "graph databases", "x"]), (2, ["indexers"]), (99, ["y"])], "note_id long, anchors array<string>")
    n = F.lit(tagged.count())
    none = F.array().cast("array<string>")
    signals = tagged.select(F.col("id").alias("note_id"), "title", none.alias("headings"), T.emphasised(F.col("body")).alias("emphasised"), F.array("tag").alias("tags")).join(anchors, "note_id", "left").withColumn("anchors", F.coalesce("anchors", none))
    lemmas = tagged.select(F.explode(F.array_distinct(F.transform(T.tokens(F.col("body")), T.singular))).alias("lemma")).groupBy("lemma").agg(F.count(F.lit(1)).alias("df"))
    assert sorted(map(tuple, M.lemma_frequencies(tagged).collect())) == sorted(map(tuple, lemmas.collect()))
    with_idf = M.phrase_costs(M.candidates(tagged), M.yake(M.word_stats(tagged, spread=True))).join(lemmas, "lemma", "left").withColumn("idf", M.smoothed_idf(n, F.col("df"))).drop("df")
    scored = M.score(M.structural(with_idf, signals))
    names = ["note_id", *[c for c, _ in M.SCORED]]
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())
    found = M.scored_notes(tagged, anchors, n)
    assert rows(found) == rows(scored) and {r.structural for r in found.collect()} >= {1.0, 2.0}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "MapInArrow" == plan.lstrip()[:10]
    assert rows(M.scored_notes(tagged, anchors, n, M.selected(3, 2))) == rows(M.select_terms(scored.select(*names), 3, 2))
    assert rows(M.scored_notes(tagged, anchors, n, M.in_pool(1, 1))) == rows(M.candidate_pool(scored, 1, 1))


def test_selection_looks_at_the_best_alone():
    """a note of very many phrases; each was met with all that were kept."""
    terms = [(f"w{i} x{i} y{i}", "phrase" if i % 2 else "keyword", 1 - i / 50_000) for i in range(50_000)]
    asked = []

    class Seen(list):
        def __getitem__(self, i):
            asked.append(i)
            return super().__getitem__(i)

    assert M._picked(Seen(terms), 3, 2, 0.7) == [0, 2, 4, 1, 3]
    assert max(asked) < 50
    with pytest.raises(M._More):
        M._picked(terms[:3], 12, 6, 0.7, whole=False)
    assert len(M.collapse([t[:2] for t in terms] + [("w8 x8", "keyword"), ("x9 y9", "keyword")])) == 50_001


def test_pool_is_found_once(spark, sf_dir):
    """the least texts of lemmas and the lists of notes each scored every note anew."""
    from lexigraph.catalogue import QUERIES

    plan = QUERIES["trm8_embedding_scores"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "yake" not in plan


def test_vectors_are_hashed_together():
    model = embedding.find_model("hashing-64")
    texts = ["", "İstanbul a1 b", "!!", "a a1 A"] * 300
    want = []
    for t in texts:
        v = np.zeros(64)
        for w in re.findall("[a-z0-9]+", t.lower()):
            v[embedding.fnv1a(w) % 64] += 1
            v[embedding.fnv1a("~" + w) % 64] += 0.5
        want.append((v / max(np.sqrt((v**2).sum()), 1e-9)).astype(np.float32))
    assert np.array_equal(np.stack(embedding.encode(texts, model)), np.stack(want)) and embedding.encode([], model) == []
