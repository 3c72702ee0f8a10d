"""Words counted within rows: the same numbers as by grouping, and no exchange of words."""

import re
from collections import Counter
from statistics import pstdev

import pytest
from pyspark.sql import functions as F

from lexigraph.catalogue import QUERIES
from lexigraph.functions import counting
from lexigraph.functions import text as T
from lexigraph.operators import terms

ODD = [(1, "A Lamp. The Lamp glows, a lamp! NASA lamp\n\nlast lamp"), (2, None), (3, ""), (4, "?? !! a"), (5, "the of the of"), (6, "Über lamp-post e.g. x_y C++ c++"), (7, "word " * 5000)]


def exchanges(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [None, 2])
def test_counted(spark, most):
    rows = spark.createDataFrame([(i, (t or "").split(" ") if t is not None else None) for i, t in ODD], "id long, tokens array<string>")
    want = {(i, w): n for i, t in ODD if t is not None for w, n in sorted(Counter(t.split(" ")).items(), key=lambda x: (-x[1], x[0]))[:most]}
    assert {(r.id, r.token): r.tf for r in counting.counted(rows, most=most).collect()} == want


def test_small_pieces_count_alike(spark, monkeypatch):
    rows = spark.createDataFrame(ODD, "id long, body string").coalesce(1)
    whole = sorted(map(tuple, terms.word_stats(rows, spread=True).collect()))
    batch = rows.select("id", T.sentences(F.col("body")).alias("ss")).toArrow().combine_chunks().to_batches()[0]
    cut = list(counting.pieces(batch, "ss", 1, counting.pc.binary_length))
    assert len(cut) > 1 and sum(b.num_rows for b in cut) == len(ODD)
    assert [r[:3] for r in whole if r[0] == 7] == [(7, "word", 5000)] and not [r for r in whole if r[0] in (2, 3, 4)]


def test_spread_of_content_words(spark):
    rows = spark.createDataFrame(ODD, "id long, body string")
    got = {r.note_id: (r["mean"], r.dev, r.most) for r in terms.note_spread(rows).collect()}
    tfs = [4, 1, 1, 1, 1]  # lamp, lamp., glows, nasa, last
    assert got[1] == (sum(tfs) / 5, pytest.approx(pstdev(tfs)), 4)
    assert got[5] == (1.0, 0.0, 1) and set(got) == {1, 5, 6, 7}


@pytest.mark.parametrize("name", ["agg17_word_stats", "trm3_yake_words", "agg16_frequency_spread", "win5_neighbour_words", "win9_median_sentence"])
def test_words_of_notes_are_not_moved(spark, sf_dir, name):
    plan = exchanges(QUERIES[name](spark, sf_dir))
    assert "Exchange" not in plan


def test_terms_of_notes_are_chosen_in_their_rows(spark, sf_dir):
    from lexigraph.catalogue import fixtures as X

    assert "Exchange" not in exchanges(X.note_terms(spark, sf_dir))


def test_words_of_the_index(spark, monkeypatch):
    """cut from the texts' bytes in tasks, as the words' pattern cuts
    them in SQL, in whole batches and in single texts."""
    from lexigraph.operators import lexical

    odd = [*ODD, (8, "a"), (9, "İstanbul K2 naïveK7 z"), (10, "end"), (11, "start"), (12, "日本x語 \0y"), (13, "!")]
    rows = spark.createDataFrame(odd, "id long, body string").repartition(2)
    want = {(r.id, r.token): (r.tf, r.len) for r in counting.counted(rows.select("id", T.search_tokens(F.col("body")).alias("tokens")).select("id", F.size("tokens").alias("len"), "tokens")).collect()}
    index = lexical.build(rows, "id", {"body": F.col("body")})
    got = {(r.doc, r.token): (r.tf, r.len) for r in index.counts.collect()}
    assert got == want and got[7, "word"] == (5000, 5000) and (10, "end") in got and (11, "start") in got
    stats = index.fields.first()
    assert stats.n == len(odd) and stats.avg_len == rows.select(F.avg(F.size(F.coalesce(T.search_tokens(F.col("body")), F.array().cast("array<string>"))))).first()[0]
    assert "regexp_extract_all" not in exchanges(index.counts) + exchanges(index.fields)
    batch = rows.coalesce(1).select("id", F.coalesce(F.lower("body"), F.lit("")).alias("text")).toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(counting, "BYTES", 1)
    assert len(list(counting.some_texts([batch], "text"))) == len(odd)
    sliced = batch.slice(3)["text"]
    data, inside, first, at = counting._text_bytes(sliced)
    assert at[0] == 0 and len(at) == len(sliced) + 1 and first.sum() == sum(len(re.findall("[a-z0-9]+", x)) for x in sliced.to_pylist())
