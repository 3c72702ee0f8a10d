"""The clustered index gives what the plain one gives, from few files and blocks."""

import random

import pytest
from pyspark.sql import functions as F

from lexigraph.operators import inverted, lexical


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60))), " ".join(rng.choices(vocabulary[:300], k=3))) for i in range(4000)]
    rows += [(5000 + i, "w7 " * 30 + "rare", "w7") for i in range(3)]
    return spark.createDataFrame(rows, "id long, body string, title string").repartition(2)


@pytest.fixture(scope="module")
def both(corpus):
    index = lexical.build(corpus, "id", {"body": F.col("body"), "title": F.col("title")})
    before = inverted.FILE_BLOCKS
    inverted.FILE_BLOCKS = 2000
    try:
        return index, inverted.write(index)
    finally:
        inverted.FILE_BLOCKS = before


QUERIES = [("a", "w1 w7 w30"), ("b", "w2999 w2500"), ("c", "rare w1"), ("d", "nothing at all"), ("e", "w0"), ("f", "w100 w200 w300 w400 w500"), ("g", "the"), ("h", ""), ("i", None)]


@pytest.mark.parametrize("k", [1, 5, 150])
def test_same_hits(spark, both, k):
    plain, clustered = both
    queries = spark.createDataFrame(QUERIES, "qid string, q string")
    for boosts in ({"body": 1.0}, {"body": 1.0, "title": 3.5}):
        want = sorted((r.qid, r["rank"], r.doc, round(r.score, 9)) for r in lexical.search(queries, plain, boosts, k).collect())
        got = sorted((r.qid, r["rank"], r.doc, round(r.score, 9)) for r in inverted.search(queries, clustered, boosts, k).collect())
        assert got == want


def test_reads_little(spark, both):
    """One rare word: one or two of the many files, and few of their bytes."""
    plain, clustered = both
    files = clustered.blocks.files.collect()
    assert len(files) > 10
    blocks = clustered.blocks.read(["w2718"])
    assert blocks.count() > 0 and len(blocks.inputFiles()) <= 2
    got = sorted(map(tuple, clustered.postings(["w2718", "w12"]).collect()))
    assert got == sorted(map(tuple, plain.postings.where("token in ('w2718', 'w12')").select("field", "token", "doc", "tf", "len", "df").collect()))
    assert clustered.blocks.read([]).count() == 0 and clustered.blocks.read(["zzzz", "!"]).count() == 0


def test_skips_intervals(spark, both):
    queries = spark.createDataFrame([("a", "rare w1"), ("b", "w7 w2000")], "qid string, q string")
    seen = {r.qid: (r.kept, r.intervals) for r in inverted.kept_intervals(queries, both[1], {"body": 1.0}, 3).collect()}
    assert all(kept < intervals for kept, intervals in seen.values())


def test_empty(spark):
    index = inverted.write(lexical.build(spark.createDataFrame([], "id long, body string"), "id", {"body": F.col("body")}))
    assert inverted.search(spark.createDataFrame([("a", "x")], "qid string, q string"), index, {"body": 1.0}, 3).count() == 0


def test_few_queries(spark, sf_dir):
    """The whole search from the packed index is the search of batches."""
    from lexigraph.catalogue import fixtures, search_queries
    from lexigraph.config import DEFAULTS, apply_patch
    from lexigraph.errors import BadRequest
    from lexigraph.plans import search

    index = search.kept(search_queries._search_index(spark, sf_dir))
    quick = search.quick(index)
    queries = fixtures.golden_queries(spark, sf_dir).orderBy("qid").limit(7)
    for mode, tolerance in (("hybrid", 1), ("lexical", 2)):
        config = apply_patch(DEFAULTS, {"search.tolerance": tolerance})
        want = {(r.qid, r["rank"]): r for r in search.search(index, queries, config, mode=mode).collect()}
        got = {(r.qid, r["rank"]): r for r in search.search_few(quick, queries, config, mode=mode).collect()}
        assert set(got) == set(want) and len({q for q, _ in got}) == 7
        for key, r in got.items():
            w = want[key]
            assert (r.id, r.title, r.via) == (w.id, w.title, w.via) and r.score == pytest.approx(w.score, abs=1.1e-6) and [s.chunk_id for s in r.snippets] == [s.chunk_id for s in w.snippets]
    with pytest.raises(BadRequest):
        search.search_few(quick, spark.range(65).selectExpr("cast(id as string) as qid", "'x' as q"))


def test_packed_from_counts_or_from_postings(spark):
    from dataclasses import replace

    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} w0") for i in range(60)], "id long, body string")
    index = lexical.build(docs, "id", {"body": F.col("body")})
    rows = lambda c: sorted(map(repr, c.blocks.read([f"w{i}" for i in range(5)]).collect()))
    assert rows(inverted.write(index)) == rows(inverted.write(replace(index, counts=None)))


def test_postings_are_moved_packed(spark, monkeypatch):
    """F8: postings were moved one by one, and again as blocks for df and for their order."""
    docs = spark.createDataFrame([(f"d{i:03}", f"w{i % 3} w{i % 5} w0 " * (1 + i % 2)) for i in range(700)], "id string, body string").repartition(3)
    index = lexical.build(docs, "id", {"body": F.col("body")})
    moved = []
    ranged = type(docs).repartitionByRange
    monkeypatch.setattr(type(docs), "repartitionByRange", lambda self, *a: moved.append(self) or ranged(self, *a))
    monkeypatch.setattr(inverted, "PACKED", 100)
    monkeypatch.setattr(inverted, "GROUP", 200)
    packed = inverted.write(index)
    rows = moved[0]
    assert rows.columns == ["token", "field", "grp", "ps"] or rows.columns == ["token", "field", "df"]
    assert not any("ps" in m.columns and m is not rows for m in moved[1:])
    words = [f"w{i}" for i in range(5)]
    want = sorted(map(tuple, index.postings.select("field", "token", "doc", "tf", "len", "df").collect()))
    assert sorted(map(tuple, packed.postings(words).collect())) == want
    blocks = packed.blocks.read(words).collect()
    assert len({(r.token, r.field, r.block) for r in blocks}) == len(blocks) and all(r.doc == sorted(r.doc) for r in blocks)
