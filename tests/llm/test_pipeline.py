"""The pipeline against a version by brute force, and its stages' promises."""

import hashlib
from collections import Counter

import corpus_pipeline as P
from lexigraph.llm import bpe, langid, simhash
from lexigraph.llm import queries as Q
from lexigraph.llm.common import materialise, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.train(docs)
    p, logp = model.tables()
    identified = {i for i, r in rows.items() if langid.has_letter(r.text) and langid.infer(r.text, p, logp)[1].max() >= 0.5}
    one = materialise(P.identify_languages(spark, docs, sf_dir), "one")
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == identified and len(identified) > 0.97 * len(rows)

    fps = {i: simhash.fingerprint(simhash.shingle_hashes(rows[i].text)) for i in identified}
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    two = materialise(P.drop_near_duplicates(spark, one, sf_dir), "two")
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(i for i in ids if find(i) == i)

    three = materialise(P.mix_sources(spark, two, sf_dir), "three")
    assert three.columns == docs.columns
    size = {r.doc_id: len(r.text.split()) for r in two.collect()}
    taken = Counter(r.doc_id for r in three.collect())
    assert set(taken) <= set(size) and max(taken.values()) <= 2
    words = sum(n * size[i] for i, n in taken.items())
    assert abs(words - 1.5 * sum(size.values())) <= 0.05 * sum(size.values())

    enc = bpe.encoder(*Q.vocabulary())
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.encode(spark, three, sf_dir).collect())
    want = Counter()
    for i, n in taken.items():
        t = enc.encode_ordinary(rows[i].text)
        want[i, len(t), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in t)).hexdigest(), hashlib.sha256(rows[i].text.encode()).hexdigest()] = n
    assert got == want
    assert got == Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, sf_dir).collect())


def test_stages_on_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "the dog of the house", "en", "a"), (3, "the dog of the house", "en", "a"), (None, "the dog of the house", "en", None), (5, "word " * 30_000, "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as copies", "2 as fp", "3 as component_id", "4 as size")
    for d in (docs, docs.limit(0)):
        for _, stage in P.STAGES[:-1]:
            d = materialise(stage(spark, d, sf_dir), "odd")
            assert d.columns == docs.columns
        P.encode(spark, d, sf_dir).collect()
