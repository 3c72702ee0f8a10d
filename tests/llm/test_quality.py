"""The quality classifier: features by definition, the update's closed form, held-out accuracy, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lexigraph.llm import quality
from lexigraph.llm import queries as Q
from lexigraph.llm.common import table

ALL = (1 << 64) - 1
BLANK = bytes([*range(9, 14), 32])
STEP, MIX, BASE = int(quality.STEP), int(quality.MIX), quality.BASE


def by_definition(text, bits=quality.BITS):
    """How often each feature occurs, word by word."""
    words, held = [], bytearray()
    for b in (text or "").encode() + b" ":
        if b in BLANK:
            if held:
                words.append(bytes(held))
            held = bytearray()
        else:
            held.append(b)

    def look(w):
        sign = [c < 128 and not chr(c).isalnum() for c in w]
        capital = [65 <= c <= 90 for c in w]
        first = next((i for i, s in enumerate(sign) if not s), 0)
        name = sum((c + 32 * up + 1) * pow(BASE, i - first, 1 << 64) for i, (c, s, up) in enumerate(zip(w, sign, capital, strict=True)) if not s) & ALL
        signs = sum((c + 1) * MIX for c, s in zip(w, sign, strict=True) if s) & ALL
        n, k = len(w) - sum(sign), sum(capital)
        case = 4 if n == 0 else 0 if k == 0 else 2 if k > 1 and 2 * k >= n else 1 if k == 1 else 3
        return (name if n else signs), (signs * MIX + (case * 4 + sign[0] + 2 * sign[-1]) * STEP) & ALL

    seen = [look(w) for w in words]
    out = []
    for i, (name, shape) in enumerate(seen):
        out += [name * STEP + 1, shape * MIX + 2]
        if i:
            same = seen[i - 1][0] == name
            twice = same and i > 1 and seen[i - 2][0] == seen[i - 1][0]
            out += [(seen[i - 1][0] * MIX + name) * STEP + 3, (seen[i - 1][1] * STEP + shape) * MIX + 4, (same + 2 * twice) * STEP + 5]
    final = Counter()
    for h in out:
        h &= ALL
        h = ((h ^ h >> 31) * MIX) & ALL
        final[((h ^ h >> 29) * STEP & ALL) >> (64 - bits)] += 1
    return final


TEXTS = ["One two, TWO!! two two (three)", None, "", " \n\t", "a", "été ÉTÉ - -- | x|y don't", "same same\nsame", "### 12 3a"]


def test_features():
    found = {i: (at, x) for i, at, x in quality.count_features(TEXTS, quality.Grams())}
    for i, text in enumerate(TEXTS):
        want = by_definition(text)
        if not want:
            assert i not in found
            continue
        at, x = found[i]
        values = {k: 1 + math.log(v) for k, v in want.items()}
        size = math.sqrt(sum(v * v for v in values.values()))
        assert at.tolist() == sorted(want) and np.allclose(x, [values[k] / size for k in sorted(want)])


def test_long_texts(monkeypatch):
    words = " ".join(f"word{i % 977} Next" for i in range(3000))
    ((_, at, x),) = quality.count_features([words], quality.Grams())
    monkeypatch.setattr(quality, "PIECE", 5000)
    ((_, at2, x2),) = quality.count_features([words], quality.Grams())
    # Pieces lose a pair at each cut, nothing else.
    assert len(set(at.tolist()) ^ set(at2.tolist())) < 60 and np.abs(x.max() - x2.max()) < 0.01
    assert len(list(quality.count_features(["x" * 20_000, words], quality.Grams()))) == 2


def test_update():
    """The weights minimise the regularised sum of linearised losses and proximal terms."""
    rng = np.random.default_rng(1)
    leader = quality.Leader.start(3)
    n, linear, pull, strength = 9, np.zeros(9), np.zeros(9), np.zeros(9)
    for _ in range(50):
        at = np.sort(rng.choice(8, 4, replace=False))
        at, x, y = np.append(at, n - 1), np.append(rng.normal(size=4), 1.0), float(rng.integers(0, 2))
        w = leader.weights()
        g = (quality.sigmoid(w[at] @ x) - y) * x
        rate = lambda s: (quality.BETA + np.sqrt(s)) / quality.ALPHA
        before = leader.n[at].copy()
        leader.learn(at, x, y)
        sigma = rate(leader.n[at]) - rate(before)
        linear[at] += g
        pull[at] += sigma * w[at]
        strength[at] += sigma
    w = leader.weights()
    slope = linear - pull + (strength + quality.BETA / quality.ALPHA + quality.L2) * w
    zero = w == 0
    assert np.all(np.abs((linear - pull)[zero]) <= quality.L1 + 1e-12) and np.allclose(slope[~zero], -np.sign(w[~zero]) * quality.L1)


def test_query(spark):
    """Whole small tables: held-out rows, the same score for the same text, reruns agree."""
    sf_dir = "/root/testdata/sf0.01"
    rows = Q.op13_quality_classifier(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    label = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    good, bad = [r.score for r in held if label[r.doc_id]], [r.score for r in held if not label[r.doc_id]]
    assert sum(a > b for a in good for b in bad) > 0.99 * len(good) * len(bad)
    assert sum(r.predicted == label[r.doc_id] for r in held) > 0.95 * len(held)
    by_text = {}
    assert all(by_text.setdefault(docs[r.doc_id], r.score) == r.score for r in rows)
    assert sorted(map(tuple, Q.op13_quality_classifier(spark, sf_dir).collect())) == sorted(map(tuple, rows))


def test_odd_rows(spark):
    long = "lorem ipsum dolor " * 80_000
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (5, long), (6, "x!! y!!"), (7, "p q r s")], "doc_id long, text string").selectExpr("*", "1 as id", "'h' as h", "2 as t", "3 as y", "4 as score", "5 as held_out", "6 as t1", "7 as quality")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, None), (5, 0), (5, 1), (None, 1), (99, 0), (7, 1)], "doc_id long, quality int").selectExpr("*", "1 as text", "2 as toxic")
    w = quality.train(docs, labels, rounds=2)
    rows = quality.score(docs, w).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i in (1, 2, 3, 3, None, 5, 6, 7))
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[1] == by[2] == {quality.sigmoid(float(w[-1]))} and by[3] == by[None] and all(len(x) == 1 for x in by.values())
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert quality.train(docs, labels.limit(0)) is None and {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.train(docs.limit(0), labels) is None and quality.score(docs.limit(0), w).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "cast(id as string) as text")
    docs = docs.unionByName(docs).unionByName(spark.range(300).selectExpr("7 as doc_id", "concat('hot ', id) as text"))
    labels = spark.range(400).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    chosen = quality.labelled_sample(docs, labels, sample=50).collect()
    assert len(chosen) == len({(r.id, r.text) for r in chosen}) == 50 and all(zlib.crc32(str(r.id).encode()) % 5 for r in chosen)
    everything = quality.labelled_sample(docs, labels).collect()
    assert len(everything) == len({(r.id, r.text) for r in everything}) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(400)) + (300 if zlib.crc32(b"7") % 5 else 0)
    assert pytest.approx(sum(r.y for r in everything if r.id != 7) / len([r for r in everything if r.id != 7]), abs=0.1) == 0.5
