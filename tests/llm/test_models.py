"""Language identification on held-out rows, and Katz scores against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lexigraph.llm import katz, langid
from lexigraph.llm import queries as Q
from lexigraph.llm.common import table


def test_op9_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}
    rows = Q.op9_language_mixture(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out and docs[r.doc_id].lang and len(docs[r.doc_id].text) > 200:
            total += 1
            right += r.lang_pred == docs[r.doc_id].lang
    assert total > 20 and right / total > 0.9


def test_op9_cases(spark):
    rows = [(i, f"the cat and the dog number {i} of the house", "en") for i in range(40)] + [(100 + i, f"le chat et le chien numéro {i} de la maison", "fr") for i in range(40)]
    rows += [(200, None, "en"), (201, "", "fr"), (202, "123 -- 456", "en"), (203, "the dog of the house", None), (203, "the dog of the house", None), (None, "le chien de la maison", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as held_out", "1 as score")
    got = defaultdict(list)
    for r in langid.identify(docs, langid.train(docs)).collect():
        got[r.doc_id].append((r.lang_pred, r.held_out))
    assert [got[i][0][0] for i in (200, 201, 202)] == ["und"] * 3
    assert [p for p, _ in got[203]] == ["en", "en"] and got[None] == [("fr", False)]
    empty = docs.limit(0)
    assert langid.identify(docs.limit(2), langid.train(empty)).first().lang_pred == "und" and langid.identify(empty, langid.train(docs)).count() == 0
    half = "the cat and the dog of the house and the number of the dog " * 5 + "le chat et le chien de la maison et le numéro de la maison " * 4
    two = langid.identify(spark.createDataFrame([(1, half)], "doc_id long, text string"), langid.train(docs)).first()
    assert set(two.languages) == {"en", "fr"} and two.lang_pred == "en"
    kept = langid.keep_identified(docs, langid.train(docs))
    assert kept.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {200, 201, 202}


def brute(docs):
    """Scores by the definitions, with dictionaries."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for i, t in docs}
    train = {i for i in toks if zlib.crc32(str(i).encode()) % 10}
    uni, bi = Counter(), Counter()
    for i in train:
        uni.update(toks[i])
        bi.update(zip(["<s>", *toks[i][:-1]], toks[i], strict=True))
    n, v = sum(uni.values()), len(uni)
    d1 = katz.good_turing(Counter(uni.values()), 5)
    d2 = katz.good_turing(Counter(bi.values()), 5, 2)
    p1 = {w: d1.get(c, 1.0) * c / n for w, c in uni.items()}
    unk = 1 - sum(p1.values())
    ctx = Counter()
    for (a, _), c in bi.items():
        ctx[a] += c
    mass, cover = Counter(), Counter()
    for (a, b), c in bi.items():
        if c >= 2:
            mass[a] += d2.get(c, 1.0) * c
            cover[a] += p1[b]
    out = {}
    for i, t in toks.items():
        s = base = 0.0
        for a, b in zip(["<s>", *t[:-1]], t, strict=True):
            base += math.log10((uni[b] + 0.1) / (n + 0.1 * (v + 1)))
            over = ctx[a] + 0.5 if mass[a] > ctx[a] - 1e-6 else ctx[a]
            c = bi[a, b] if i in toks else 0
            if c >= 2:
                s += math.log10(d2.get(c, 1.0) * c / over)
            else:
                alpha = (1 - mass[a] / over) / (1 - cover[a]) if ctx[a] else 1.0
                s += math.log10(alpha * p1.get(b, unk))
        out[i] = (i not in train, len(t), sum(w in uni for w in t), n, base, s)
    return out


@pytest.mark.parametrize("part_bytes", [25_000_000, 20_000])
def test_op10(spark, sf_dir, part_bytes):
    docs = table(spark, sf_dir, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = katz.score_documents(docs, part_bytes=part_bytes).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert math.isclose(r.base_score, w[4], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, w[5], rel_tol=1e-7, abs_tol=1e-6)


def test_op10_cases(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b a b"), (3, "x " * 70_000), (10, "a b zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as train", "'' as part")
    got = katz.score_documents(docs).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert next(r for r in got if r.doc_id == 3).n_tokens == 70_001
    assert katz.score_documents(docs.limit(0)).count() == 0


def test_katz_sums_to_one(spark):
    """Each context's probabilities over known words and the unknown one."""
    rows = [(i, t) for i, t in enumerate(["a b a b c", "a b c a", "b c a b a b", "c c c a b", "a a b d", "b a c"] * 5)]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "true as train")
    m = katz.KatzModel(docs)
    words = {r.h: r for r in m.words.collect()}
    gains = {(r.w1, r.w2): r.gain for r in m.bigrams.collect()}
    logp = lambda c: math.log10(m.word_discounts.get(c, 1.0) * c / m.n * m.known_scale)
    for v in words:
        if v == katz.END:
            continue
        total = 10 ** (words[v].back) * m.unknown
        for w, r in words.items():
            if w != katz.START:
                total += 10 ** (words[v].back + logp(r.c) + gains.get((v, w), 0.0))
        assert math.isclose(total, 1.0, rel_tol=1e-9)
