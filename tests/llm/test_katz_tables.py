"""Katz tables of order 3 by a version with dictionaries and discounts of its own,
by sums, and against the packed bigrams."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexigraph.llm import katz, katz_tables
from lexigraph.llm.common import table


def discounts(counts, most=5):
    """Katz's scaling of Good-Turing, written from its definition; where an
    estimate isn't between 0 and 1, absolute discounting."""
    n = Counter(counts)
    rest = (most + 1) * n[most + 1] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, most + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else None
        d = (ratio - rest) / (1 - rest) if ratio is not None and rest < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - min(n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5, 0.9)) / r
    return out


class Brute:
    def __init__(self, texts, order):
        self.order, self.c = order, [Counter() for _ in range(order + 1)]
        for t in texts:
            for g in self.grams(t):
                for n in range(1, order + 1):
                    self.c[n][g[-n:]] += 1
        self.d = [discounts(c.values()) for c in self.c]
        self.total = sum(self.c[1].values())
        self.p1 = {g[0]: self.d[1].get(c, 1.0) * c / self.total for g, c in self.c[1].items()}
        self.unknown = 1 - sum(self.p1.values())
        self.after = defaultdict(dict)
        for n in range(2, order + 1):
            for g, c in self.c[n].items():
                self.after[g[:-1]][g[-1]] = c

    def grams(self, text):
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        t = ["<s>"] * (self.order - 1) + re.findall(r"[^\x20\x09-\x0D]+", low) + [None]
        return [tuple(t[i : i + self.order]) for i in range(len(t) - self.order + 1)]

    def p(self, w, context):
        if not context:
            return self.p1.get(w, self.unknown)
        seen = self.after.get(context)
        if not seen:
            return self.p(w, context[1:])
        d, total = self.d[len(context) + 1], sum(seen.values())
        mass = sum(d.get(c, 1.0) * c for c in seen.values())
        over = total + 0.5 if mass > total - 1e-6 else total
        if w in seen:
            return d.get(seen[w], 1.0) * seen[w] / over
        return (1 - mass / over) / (1 - sum(self.p(x, context[1:]) for x in seen)) * self.p(w, context[1:])


@pytest.mark.parametrize("order", [1, 3])
def test_by_brute_force(spark, sf_dir, order):
    docs = table(spark, sf_dir, "documents").where(F.length("text") < 3000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    b = Brute([t for i, t in rows if zlib.crc32(str(i).encode()) % 10], order)
    got = {r.doc_id: r for r in katz_tables.score_by_tables(docs, order=order).collect()}
    assert len(got) == len(rows) > 90
    for i, t in rows:
        grams = b.grams(t)
        want = sum(math.log10(b.p(g[-1], g[:-1])) for g in grams)
        base = sum(math.log10((b.c[1][g[-1:]] + 0.1) / (b.total + 0.1 * (len(b.c[1]) + 1))) for g in grams)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(grams), sum(b.c[1][g[-1:]] > 0 for g in grams), b.total)
        assert math.isclose(r.score, want, rel_tol=1e-8, abs_tol=1e-7) and math.isclose(r.base_score, base, rel_tol=1e-9)


def test_order_three_sums_to_one(spark):
    texts = ["a b a b c", "a b c a", "b c a b a b", "c c c a b", "a a b d", "b a c", "d"]
    df = spark.createDataFrame([(t, 1 + i % 3) for i, t in enumerate(texts)], "text string, m long")
    model = katz_tables.KatzTables(katz_tables.ngrams(df, 3, "m"), 3)
    words = [r.w for r in model.levels[1].collect()]
    contexts = model.levels[3].select("k", "low").distinct()
    grams = contexts.crossJoin(spark.createDataFrame([(w,) for w in [*words, 12345]], "w long")).select(F.lit(0).cast("long").alias("k1"), F.col("low").alias("k2"), F.col("k").alias("k3"), "w")
    sums = model.evaluate(grams).groupBy("k3").agg(F.sum(F.pow(F.lit(10.0), "logp")).alias("p")).collect()
    assert len(sums) > 8 and all(math.isclose(r.p, 1.0, rel_tol=1e-9) for r in sums)


def test_like_the_packed_bigrams(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = {r.doc_id: r for r in katz.score_documents(docs, min_count=1).collect()}
    b = {r.doc_id: r for r in katz_tables.score_by_tables(docs, order=2).collect()}
    assert a.keys() == b.keys()
    for i, x in a.items():
        assert (x.n_tokens, x.n_known, x.train_tokens) == (b[i].n_tokens, b[i].n_known, b[i].train_tokens) and math.isclose(x.score, b[i].score, rel_tol=1e-7, abs_tol=1e-6)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b a b"), (3, "x " * 3000), (10, "a b zz"), (10, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as w", "2 as m", "'' as k1")
    got = katz_tables.score_by_tables(docs).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert katz_tables.score_by_tables(docs.limit(0)).count() == 0
