"""The registered queries against brute force over whole small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lexigraph.llm import queries as Q
from lexigraph.llm.common import table

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [r.asDict() for r in table(spark, sf_dir, "documents").collect()]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_op1(spark, sf_dir, docs):
    got = {r.doc_id: r for r in Q.op1_media_columns(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        raw = (d["text"] or "").encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[d["doc_id"]]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest())
        assert r.tail_crc32 == zlib.crc32(pad[-64:]) and r.media_bytes > r.payload_bytes


def test_op2(spark, sf_dir, docs):
    import xxhash

    fps = {}
    for d in docs:
        w = SPACE.findall(lower(d["text"]))
        sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
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
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op2_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in ids}


ALL = (1 << 64) - 1
STEP, BASE, NONE = 0x9E3779B97F4A7C15, 0x100000001B3, 0x6A09E667F3BCC908


def split_mix(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & ALL
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & ALL
    return x ^ x >> 31


def order_min_hash(text, k=16, l=2, m=32):  # noqa: E741
    """By the definition, k-mer by k-mer: a k-mer's hash is that of a polynomial in
    its code points' hashes; a repeated one is numbered by its occurrence."""
    kmers = [text[i : i + k] for i in range(len(text) - k + 1)] if len(text) >= k else [text] if text else []
    seen, values = Counter(), []
    for x in kmers:
        h = 0
        for c in x:
            h = (h * BASE + split_mix((ord(c) + STEP) & ALL)) & ALL
        h, n = split_mix(h), seen[x]
        seen[x] += 1
        values.append(split_mix((h + n * STEP) & ALL) if n else h)
    out = []
    for f in range(1, m + 1):
        a = split_mix((f * STEP) & ALL) | 1
        acc = NONE
        for i in sorted(sorted(range(len(values)), key=lambda i: (values[i] * a & ALL, i))[:l]):
            acc = split_mix((acc * STEP + values[i]) & ALL)
        out.append(acc >> 32)
    return out


def test_op3(spark, sf_dir, docs):
    got = {r.doc_id: r for r in Q.op3_order_minhash(spark, sf_dir).collect()}
    docs = sorted(docs, key=lambda d: d["doc_id"])
    assert len(got) == len(docs)
    for i, d in enumerate(docs):
        t, nxt = d["text"] or "", docs[(i + 1) % len(docs)]["text"] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        r = got[d["doc_id"]]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if i % 10 == 0 and len(t) < 4000:
            a, b, c = map(order_min_hash, (t, edited, nxt))
            assert r.fingerprint == "".join(f"{x:08x}" for x in a) and r.edited_fingerprint == "".join(f"{x:08x}" for x in b)
            assert r.near_edited == sum(x == y for x, y in zip(a, b, strict=True)) / 32
            assert r.near_next == sum(x == y for x, y in zip(a, c, strict=True)) / 32
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)


def test_op5(spark, sf_dir, docs):
    from lexigraph.llm import bpe

    path, pattern = Q.vocabulary()
    enc = bpe.encoder(path, pattern)
    for size, overlap in ((bpe.CHUNK, bpe.OVERLAP), (200, 60)):
        got = {r.doc_id: r for r in bpe.encode_documents(table(spark, sf_dir, "documents"), path, pattern, size=size, overlap=overlap).collect()}
        assert len(got) == len(docs)
        for d in docs:
            ids = enc.encode_ordinary(d["text"] or "")
            r = got[d["doc_id"]]
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_op7(spark, sf_dir, docs):
    rows = Q.op7_rendezvous_sharding(spark, sf_dir).collect()
    text = {d["doc_id"]: d["text"] or "" for d in docs}
    slots = defaultdict(list)
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key") and 0 <= r.shard < 8
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in rows) == sorted(text) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 0.04 < sum(r.grown_shard == 8 for r in rows) / len(rows) < 0.2


def test_op8(spark, sf_dir, docs):
    size = {d["doc_id"]: len(SPACE.findall(d["text"] or "")) for d in docs}
    of = {d["doc_id"]: d["source"] for d in docs}
    total = Counter()
    for i, s in of.items():
        total[s] += size[i]
    names = sorted(total, key=lambda s: (s is None, s))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(total.values()), {}, set(names)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
    rows = Q.op8_pivotal_mixing(spark, sf_dir).collect()
    taken, largest = Counter(), Counter()
    for r in rows:
        s = of[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and math.isclose(r.target, target[s], rel_tol=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert sorted(r.doc_id for r in rows) == sorted(of)
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in names)
    again = {r.doc_id: r.taken for r in Q.op8_pivotal_mixing(spark, sf_dir).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = Q.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)
