"""Words within k edits against all pairs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigraph.operators import lexical, typos


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.lists(st.text("abcé😀", max_size=7), max_size=60), st.text("abcé😀", max_size=7), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_walk(words, asked, k):
    words = sorted(set(words))
    assert list(typos.walk(words, asked, k)) == [w for w in words if distance(w, asked) <= k]


def test_last_character():
    words = sorted(["\U0010ffff" * n + t for n in range(4) for t in ("", "a", "bcdef")] + ["a"])
    assert list(typos.walk(words, "a", 1)) == [w for w in words if distance(w, "a") <= 1]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_near_words(spark, monkeypatch, k):
    rng = random.Random(k)
    vocabulary = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(400)})
    asked = rng.sample(vocabulary, 20) + ["".join(rng.choices("abcd", k=7)) for _ in range(20)] + ["zzzzzzzzz"]
    monkeypatch.setattr(typos, "ASKED", 10)
    v = spark.createDataFrame([(w,) for w in vocabulary] * 2 + [(None,)], "token string").repartition(3)
    got = sorted(map(tuple, typos.near_words(spark.createDataFrame([(w,) for w in [*asked, *asked, None]], "asked string"), v, k).collect()))
    assert got == sorted((a, w) for a in set(asked) for w in vocabulary if distance(a, w) <= k)
    if k:
        tokens = spark.createDataFrame([("q", 1, a) for a in asked], "qid string, n_tokens int, token string")
        assert sorted((r.asked, r.token) for r in lexical.expand_typos(tokens, v, k).collect()) == got


def test_bounds(spark):
    with pytest.raises(ValueError):
        typos.near_words(spark.createDataFrame([], "asked string"), spark.createDataFrame([], "token string"), 4)
    assert typos.near_words(spark.createDataFrame([], "asked string"), spark.createDataFrame([("a",)], "token string"), 2).count() == 0
