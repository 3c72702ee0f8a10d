"""Language mixtures, shards, URL buckets, chunked encoding and components
against versions by brute force."""

import hashlib
import math
import random
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

from lexigraph.llm import bpe, components, langid, sharding, urls
from lexigraph.llm import queries as Q
from lexigraph.llm.common import table


def hashed_trigrams(text, bits=15):
    raw = b" " + text.lower().encode(errors="replace") + b" "
    return Counter((((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761) & 0xFFFFFFFF) >> (32 - bits) for i in range(len(raw) - 2))


def em(probs, counts, pi):
    n = sum(counts.values())
    for _ in range(40):
        new = [0.0] * len(pi)
        for g, c in counts.items():
            mixed = sum(p * probs[l][g] for l, p in enumerate(pi))
            for l, p in enumerate(pi):
                new[l] += p * c * probs[l][g] / mixed / n
        moved = max(abs(a - b) for a, b in zip(pi, new, strict=True))
        pi = new
        if moved < 1e-4:
            break
    return pi, sum(c * math.log(sum(p * probs[l][g] for l, p in enumerate(pi))) for g, c in counts.items())


def mixture(counts, tables):
    """Greedy choice of languages by penalised likelihood, with dictionaries: all
    languages are tried at every step."""
    n = sum(counts.values())
    alone = {x: sum(c * math.log(t[g]) for g, c in counts.items()) for x, t in tables.items()}
    best = max(sorted(tables), key=alone.get)
    posterior = 1 / sum(math.exp((v - alone[best]) / 3) for v in alone.values())
    chosen, pi, ll = [best], [1.0], alone[best]
    while len(chosen) < len(tables):
        tries = []
        for other in sorted(set(tables) - set(chosen)):
            new, gain = em([tables[x] for x in [*chosen, other]], counts, [*(p * 0.9 for p in pi), 0.1])
            if gain - ll > 1.5 * math.log(n):
                tries.append((gain, other, new))
        if not tries:
            break
        ll, other, pi = max(tries, key=lambda t: t[0])
        chosen.append(other)
    return chosen, pi, posterior


def test_op9_row_by_row(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").collect()
    sums, total = defaultdict(Counter), Counter()
    import zlib

    for d in docs:  # fewer rows of a language than the sample's bound: all train
        if d.lang is not None and d.text is not None and zlib.crc32(str(d.doc_id).encode()) % 4 != 2:
            sums[d.lang] += hashed_trigrams(d.text)
    for x, c in sums.items():
        total[x] = sum(c.values())
    tables = {x: [(c[g] + 0.5) / (total[x] + 0.5 * 2**15) for g in range(2**15)] for x, c in sums.items()}
    got = {r.doc_id: r for r in Q.op9_language_mixture(spark, sf_dir).collect()}
    for d in docs:
        r = got[d.doc_id]
        if d.text is None or not any(map(str.isalpha, d.text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        chosen, pi, posterior = mixture(hashed_trigrams(d.text), tables)
        top = max(range(len(pi)), key=lambda i: pi[i])
        assert r.lang_pred == chosen[top] and math.isclose(r.score, min(1.0, pi[top]) * posterior, rel_tol=1e-6, abs_tol=1e-9)


def test_op9_sample_is_exact(spark):
    rows = [(7, "en", f"text {i}") for i in range(300)] + [(7, "en", "same")] * 300 + [(i, "fr", f"texte {i}") for i in range(500)] + [(i, "de", "x") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    for n in (1, 50, 450):
        got = Counter(r.lang for r in langid.sampled(df, n).collect())
        assert got == {"en": n, "fr": n, "de": min(n, 20)}
    assert langid.train(df.limit(0).withColumnRenamed("id", "doc_id")).languages == ()
    long = "the quick brown fox " * 120_000
    assert (langid.gram_counts(long) == sum((langid.np.bincount([g], weights=[c], minlength=2**15) for g, c in hashed_trigrams(long).items()), langid.np.zeros(2**15))).all()


def rendezvous(key, weights):
    def unit(i):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        return ((xxhash.xxh64_intdigest(struct.pack("<i", i), seed) >> 11) + 0.5) / 2**53

    return max(range(len(weights)), key=lambda i: (-weights[i] / math.log(unit(i)), -i))


def test_op7_by_brute_force(spark, sf_dir):
    for r in Q.op7_rendezvous_sharding(spark, sf_dir).collect():
        assert r.shard == rendezvous(r.doc_id, [1.0] * 8) and r.grown_shard == rendezvous(r.doc_id, [1.0] * 9)
    rows = [(None, f"t{i}") for i in range(40)] + [(5, "x")] * 6 + [(i, None) for i in range(100, 130)]
    weights = [1.0, 3.0, 0.5]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), weights, slot_buckets=4).collect()
    slots = defaultdict(list)
    for r in got:
        assert r.shard == rendezvous(r.doc_id, weights)
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("prefix_hex", [1, 2, 8])
def test_op4_prefixes_that_clash(spark, prefix_hex):
    """With one hexadecimal digit, many rules share a prefix: digests tell them apart."""
    rules = [(f"h{i}.org", f"/p{j}/", "block" if (i + j) % 2 else "allow") for i in range(6) for j in range(6)] + [("org", "/", "block"), ("h1.org", "/", "allow")]
    pages = [(n, f"http://{sub}h{i}.org/p{j}/x?q#f") for n, (sub, i, j) in enumerate((s, i, j) for s in ("", "a.") for i in range(7) for j in range(7))] + [(900, None), (901, "h1.org/p1/"), (902, "http://net"), (902, "http://net")]
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert prefix_hex > 2 or urls.buckets(r.selectExpr("host as r_host", "concat(host, path) as rule", "verdict as r_verdict"), prefix_hex).count() < len(rules)
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), r, prefix_hex=prefix_hex).collect()
    assert len(got) == len(pages)
    for g in got:
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (g.host == h or g.host.endswith("." + h)) and g.path.startswith(p)]
        assert (g.rule, g.verdict) == (max(fits)[3:] if fits else (None, "allow"))


def test_op5_pieces_around_long_pretokens(spark):
    """Overlaps within one pre-token never resynchronise: only their neighbours join."""
    path, pattern = Q.vocabulary()
    enc = bpe.encoder(path, pattern)
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdé漢 1'", k=rng.randrange(1, 9))) for _ in range(n))
    texts = [words(200) + "x" * 700 + words(200), "y" * 900, words(400), " " * 500 + "\n" * 500, "a", "", None, words(90) + "z" * 130 + " it's" * 80, "漢字" * 300]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs, path, pattern, size=100, overlap=40).collect())
    want = []
    for i, t in [*enumerate(texts), (0, texts[0])]:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    rows = spark.createDataFrame([("r", 1, texts[0])], "row string, doc long, text string")
    pieces = [r.decoded.decode() for r in bpe.encode_long(rows, path, pattern, 100, 40).orderBy("no").collect()]
    assert "".join(pieces) == texts[0] and len(pieces) > 5 and max(map(len, pieces)) < 1100


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 30)] + [(300, 301)] * 3 + [(400, 400)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {x: root(x) for x in parent}
    assert got == {x: c for x, c in want.items() if x != c} | {c: c for c in got if got[c] == c and c in want}
    assert all(got.get(x, x) == c for x, c in want.items())
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
