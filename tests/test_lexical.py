"""Search of a text index: words counted in rows, pairs cut in tasks, the same answers."""

import random

import pytest
from pyspark.sql import functions as F

from lexigraph.operators import lexical


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 200}" for _ in range(4000)]
    # Copies make ties; one document has more words than a task holds at once.
    rows = [(i, " ".join(words[(i % 97) * 20 : (i % 97) * 20 + 30]), f"w{i % 7}") for i in range(300)] + [(300, " ".join(words), "w1"), (301, None, "")]
    return spark.createDataFrame(rows, "id long, body string, title string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(f"q{i}", f"w{i} w{i * 3} w1") for i in range(12)] + [("none", "zzz")], "qid string, q string")


def test_words_are_counted_without_moving_them(corpus):
    index = lexical.build(corpus, "id", {"body": F.col("body")})
    plan = index.counts._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_cut_in_tasks_or_joined(corpus, asked, monkeypatch, k):
    index = lexical.build(corpus, "id", {"body": F.col("body"), "title": F.col("title")})
    boosts = {"body": 1.0, "title": 2.5}
    best = lambda: sorted((r.qid, r["rank"], r.doc, round(r.score, 8)) for r in lexical.search(asked, index, boosts, k).collect())
    monkeypatch.setattr(lexical, "MOST_ASKED", 0)
    joined = best()
    monkeypatch.setattr(lexical, "MOST_ASKED", 100)
    assert best() == joined and joined
    for name, n in (("TASK_ROWS", 500), ("HELD_ROWS", 40), ("CELLS", 60)):
        monkeypatch.setattr(lexical, name, n)
    assert list(best()) == joined


def test_pieces_of_a_task(corpus, asked):
    """Straight through the function of a task, in one piece and in small ones."""
    import numpy as np
    import pyarrow as pa

    ask = lexical._Asked(pa.array(["a", "b"]), pa.array(["x", "y"]), np.array([0, 2, 3]), np.array([0, 1, 1]), np.array([1.0, 1.0, 2.0]))
    rows = pa.table({"token": ["x", "y", "x", "y", "y"], "doc": [1, 1, 2, 3, 3], "part": [1.0, 0.5, 3.0, 0.25, 0.25]})
    got = {(r["qid"], r["doc"]): r["score"] for b in lexical._best_of(rows, ask, 2) for r in b.to_pylist()}
    assert got == {("a", 1): 1.0, ("a", 2): 3.0, ("b", 1): 2.0, ("b", 2): 3.0}


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_all_words_in_tasks(spark, corpus, asked, monkeypatch, k):
    """The same as by joins of pairs, in one block and in several, in small pieces; a
    word of no document finds nothing, and sets that several ask for are met once."""
    index = lexical.build(corpus, "id", {"body": F.col("body"), "title": F.col("title")})
    boosts = {"body": 1.0, "title": 2.5}
    more = asked.unionByName(spark.createDataFrame([("twice", "w1 w3 w1"), ("order", "w3 w1"), ("half", "w1 zzz"), ("empty", None), ("blank", "!")], "qid string, q string"))
    want = sorted((r.qid, r["rank"], r.doc, round(r.score, 8)) for r in lexical.rank(lexical.matches(more, index, require_all=True), boosts, k, True).collect())
    best = lambda: sorted((r.qid, r["rank"], r.doc, round(r.score, 8)) for r in lexical.search(more, index, boosts, k, require_all=True).collect())
    assert best() == want and {"twice", "order"} <= {x[0] for x in want} and not {"half", "empty", "none"} & {x[0] for x in want}
    for name, n in (("BLOCK_WORDS", 12), ("TASK_ROWS", 500), ("WHOLE_ROWS", 900), ("HELD_ROWS", 40), ("CELLS", 60), ("MATCHES", 30), ("MOST_ASKED", 0)):
        monkeypatch.setattr(lexical, name, n)
    assert best() == want


def test_pairs_without_a_match_are_no_rows(spark):
    """Sets whose rarest word is in every document: only what matches leaves a task."""
    docs = spark.createDataFrame([(i, f"a b c d w{i}") for i in range(40)], "id long, body string")
    queries = spark.createDataFrame([(f"q{i}", f"a b c d w{i % 50}") for i in range(50)], "qid string, q string")
    plans = []
    found = lexical.search(queries, lexical.build(docs, "id", {"body": F.col("body")}), {"body": 1.0}, 5, require_all=True)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.qid, r.doc) for r in found.collect()) == sorted((f"q{i}", i) for i in range(40))
    assert "MapInArrow" in plans[0] and "Join [token" not in plans[0]


def test_all_words_straight_through(monkeypatch):
    """The functions of a task without Spark, whole and in small pieces."""
    import pyarrow as pa

    asked = pa.table({"set": ["a b", "a b", "b", "a z", "a z"], "token": ["a", "b", "b", "a", "z"], "df": [3, 2, 2, 3, 0]})
    rows = pa.table({"token": ["a", "b", "b", "a", "b", "a"], "doc": [1, 1, 1, 2, 3, 4], "part": [1.0, 0.5, 0.25, 9.0, 2.0, 1.0]})
    for cells, matches in ((1 << 20, 1 << 20), (2, 1)):
        monkeypatch.setattr(lexical, "CELLS", cells)
        monkeypatch.setattr(lexical, "MATCHES", matches)
        ask = lexical._sets(asked)
        for k in (1, 2):
            got = {(ask.sets[r["at"]].as_py(), r["doc"]): r["score"] for b in lexical._best_of_sets(iter([rows]), ask, k) for r in b.to_pylist()}
            assert got[("a b", 1)] == 1.75 and got[("b", 3)] == 2.0 and set(got) <= {("a b", 1), ("b", 3), ("b", 1)}
            assert k == 1 or got[("b", 1)] == 0.75


def test_candidates_meet_their_own_words_first(spark):
    """With typos a query has very many words near its own, a title few: candidates
    are joined with what they have before what is asked for."""
    docs = spark.createDataFrame([(i, f"wa{i % 9} wb{i % 5}") for i in range(60)], "id long, title string")
    queries = spark.createDataFrame([("q", "wa1 wb2"), ("r", "wa33 wb1 xyz")], "qid string, q string")
    found = lexical.matches(queries, lexical.build(docs, "id", {"title": F.col("title")}), 1, require_all=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert any("(doc#" in line for line in joins) and not any("(token#" in line and "(doc#" in line for line in joins)
    best = lexical.rank(found, {"title": 1.0}, 100, True).collect()
    assert sorted(r.doc for r in best if r.qid == "q") == list(range(60)) and not [r for r in best if r.qid == "r"]


def test_one_batch_finds_what_a_kept_index_finds(spark, sf_dir):
    """Without stored postings, vectors or a look-up of active notes."""
    from lexigraph.catalogue import search_queries as Q
    from lexigraph.plans import search as S

    asked = Q.X.golden_queries(spark, sf_dir).limit(12)
    shown = lambda index: sorted((r.qid, r["rank"], r.id, r.score, r.snippets) for r in S.search(index, asked).select("qid", "rank", "id", "score", F.transform("snippets", lambda s: s["text"]).alias("snippets")).collect())
    one = Q._batch_index(spark, sf_dir)
    assert "hashpartitioning" not in one.vectors._jdf.queryExecution().executedPlan().toString()
    assert shown(one) == shown(S.kept(Q._search_index(spark, sf_dir))) != []


def test_golden_set_leaves_texts_in_their_rows(spark, sf_dir):
    from lexigraph.catalogue import search_queries as Q

    plan = Q.golden(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1 and "explode(array_distinct" not in plan


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_texts_are_scored_where_they_lie(corpus, asked, monkeypatch, k):
    """no postings are written or moved for one batch, and the answers are
    those of the postings, whole and in small pieces; a field without a boost adds nothing."""
    from dataclasses import replace

    from lexigraph.functions import counting

    index = lexical.build(corpus, "id", {"body": F.col("body"), "title": F.col("title")})
    written, write = [], lexical.materialise
    monkeypatch.setattr(lexical, "materialise", lambda df, name, *a: written.append(name) or write(df, name, *a))
    best = lambda i, boosts: sorted((r.qid, r["rank"], r.doc, round(r.score, 8)) for r in lexical.search(asked, i, boosts, k).collect())
    for boosts in ({"body": 1.0, "title": 2.5}, {"body": 1.0, "title": 0.0}):
        got = best(index, boosts)
        assert "asked-postings" not in written
        assert got == best(replace(index, texts=None), boosts) and got and "asked-postings" in written
        for module, name, n in ((lexical, "HELD_ROWS", 40), (lexical, "CELLS", 60), (counting, "BYTES", 100)):
            monkeypatch.setattr(module, name, n)
        assert best(index, boosts) == got
        written.clear()
    assert best(index, {"body": 0.0}) == []


def test_hits_texts_stay_where_they_are(spark, sf_dir):
    """what both passes found is sent to the texts, and snippets meet by digests."""
    from lexigraph.catalogue import QUERIES

    plan = QUERIES["ret9_snippets"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("chunk_id#" in line.split("Exchange")[1].split(",")[0] or "text_of" in line for line in moved)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_hits_are_searched_once(spark, sf_dir):
    """votes read the hits twice, the texts are searched once."""
    from lexigraph.catalogue import QUERIES

    plan = QUERIES["gra4_expansion"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
