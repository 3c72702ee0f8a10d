"""The query's Katz model keeps every bigram: against brute force, and by sums."""

import math
import re
import zlib
from collections import Counter

import pytest

from lexigraph.llm import katz
from lexigraph.llm import queries as Q
from lexigraph.llm.common import table


def brute(docs):
    """Scores with all bigrams, with dictionaries."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for i, t in docs}
    uni, bi, ctx, mass, cover = Counter(), Counter(), Counter(), Counter(), Counter()
    for i, t in toks.items():
        if zlib.crc32(str(i).encode()) % 10:
            uni.update(t)
            bi.update(zip(["<s>", *t[:-1]], t, strict=True))
    n = sum(uni.values())
    d1, d2 = katz.good_turing(Counter(uni.values()), 5), katz.good_turing(Counter(bi.values()), 5)
    assert set(d2) == {1, 2, 3, 4, 5}
    p1 = {w: d1.get(c, 1.0) * c / n for w, c in uni.items()}
    for (a, b), c in bi.items():
        ctx[a] += c
        mass[a] += d2.get(c, 1.0) * c
        cover[a] += p1[b]
    out = {}
    for i, t in toks.items():
        s = 0.0
        for a, b in zip(["<s>", *t[:-1]], t, strict=True):
            over = ctx[a] + 0.5 if mass[a] > ctx[a] - 1e-6 else ctx[a]
            if bi[a, b]:
                s += math.log10(d2.get(bi[a, b], 1.0) * bi[a, b] / over)
            else:
                s += math.log10(((1 - mass[a] / over) / (1 - cover[a]) if ctx[a] else 1.0) * p1.get(b, 1 - sum(p1.values())))
        out[i] = s
    return out


def test_query_keeps_all_bigrams(spark, sf_dir):
    want = brute([(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()])
    got = {r.doc_id: r.score for r in Q.op10_katz_scores(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-7, abs_tol=1e-6) for i in want)


@pytest.mark.parametrize("part_bytes", [20_000, 1_000])
def test_all_bigrams_in_many_parts(spark, sf_dir, part_bytes):
    docs = table(spark, sf_dir, "documents").limit(60)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.score for r in katz.score_documents(docs, part_bytes=part_bytes, min_count=1).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-7, abs_tol=1e-6) for i in want)


def test_bigrams_seen_once(spark):
    rows = [(i, f"w{i} x{i} y{i}") for i in range(1, 40)]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "true as train")
    m = katz.KatzModel(docs, part_bytes=100, min_count=1)
    words = {r.h: r for r in m.words.collect()}
    pairs = m.bigrams.collect()
    assert len(pairs) == 4 * len(rows) and all(r.gain > 0 for r in pairs if r.w2 != katz.END)
    p = lambda w: math.log10(m.word_discounts.get(words[w].c, 1.0) * words[w].c / m.n * m.known_scale)
    gains = {(r.w1, r.w2): r.gain for r in pairs}
    for v in words.keys() - {katz.END}:
        total = 10 ** words[v].back * m.unknown + sum(10 ** (words[v].back + p(w) + gains.get((v, w), 0.0)) for w in words.keys() - {katz.START})
        assert math.isclose(total, 1.0, rel_tol=1e-9)
