"""Containers by an independent reader, broken ones, and fragmented ones."""

import hashlib
import re
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigraph.llm import media
from lexigraph.llm import queries as Q
from lexigraph.llm.common import table


def find(data, *path):
    """The body of the first box at a path; a plain search, box by box."""
    at, end = 0, len(data)
    for kind in path:
        while at < end:
            size, name = struct.unpack(">I4s", data[at : at + 8])
            if name == kind:
                at, end = at + 8 + (8 if kind == b"stsd" else 0), at + size
                break
            at += size
        else:
            raise AssertionError(kind)
    return data[at:end]


STBL = (b"moov", b"trak", b"mdia", b"minf", b"stbl")


def independent(data):
    """(payload, feature) by the tables' definitions, entry by entry."""
    scale = struct.unpack(">I", find(data, b"moov", b"trak", b"mdia", b"mdhd")[20:24])[0]
    handler = find(data, b"moov", b"trak", b"mdia", b"hdlr")[8:12].decode()
    codec = find(data, *STBL, b"stsd")[4:8].decode()
    size, n = struct.unpack(">II", find(data, *STBL, b"stsz")[4:12])
    chunks = [struct.unpack(">I", find(data, *STBL, b"stco")[8 + 4 * i : 12 + 4 * i])[0] for i in range(struct.unpack(">I", find(data, *STBL, b"stco")[4:8])[0])]
    runs = [struct.unpack(">III", find(data, *STBL, b"stsc")[8 + 12 * i : 20 + 12 * i]) for i in range(struct.unpack(">I", find(data, *STBL, b"stsc")[4:8])[0])]
    where = []
    for i, at in enumerate(chunks, 1):
        for _ in range([r[1] for r in runs if r[0] <= i][-1]):
            where.append(at)
            at += size
    assert len(where) == n
    keys = [struct.unpack(">I", find(data, *STBL, b"stss")[8 + 4 * i : 12 + 4 * i])[0] for i in range(struct.unpack(">I", find(data, *STBL, b"stss")[4:8])[0])]
    ticks = sum(a * b for a, b in [struct.unpack(">II", find(data, *STBL, b"stts")[8:16])])
    ranges = ",".join(f"{where[k - 1]}+{size}" for k in keys)
    return b"".join(data[a : a + size] for a in where), f"{handler}/{codec.strip()} scale={scale} duration={ticks} samples={n} keyframes={len(keys)} ranges={hashlib.sha256(ranges.encode()).hexdigest()[:16]}"


def test_query_by_an_independent_reader(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    stored = {r.id: bytes(r.media) for r in media.store_texts(table(spark, sf_dir, "documents")).collect()}
    for r in Q.op1_media_columns(spark, sf_dir).collect():
        raw = (docs[r.doc_id] or "").encode()
        payload, feature = independent(stored[r.doc_id])
        assert payload == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert r.feature == feature and r.media_sha256 == hashlib.sha256(stored[r.doc_id]).hexdigest() and r.media_bytes == len(stored[r.doc_id])


WHOLE = media.write_container(bytes(range(256)) * 300)


@given(st.lists(st.tuples(st.integers(0, 1200), st.sampled_from([b"\xff\xff\xff\xff", b"\0\0\0\0", b"\0\0\0\x01", b"\x7f", b"moov", b"trun"])), min_size=1, max_size=8), st.integers(0, len(WHOLE)))
@settings(max_examples=400, deadline=None)
def test_altered_bytes(changes, length):
    for keep in (len(WHOLE), length):
        b = bytearray(WHOLE[:keep])
        for at, new in changes:
            b[at : at + len(new)] = new[: max(0, len(b) - at)]
        x, t = media.describe(bytes(b))
        assert (t is None) == ("error" in x)
        if t is not None:
            assert all(0 <= a and a + n <= len(b) for a, n in t.key_ranges)


def box(kind, *parts):
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def full(kind, *parts, flags=0):
    return box(kind, struct.pack(">I", flags), *parts)


def test_malformed():
    deep = b""
    for _ in range(3000):
        deep = box(b"moov", deep)
    cases = [None, b"", b"x", deep, box(b"moov"), box(b"moov", box(b"trak"))]
    for name, at, new in ((b"stss", 12, 10**6), (b"stss", 12, 0), (b"stsc", 8, 5), (b"stsc", 8, 0), (b"stsz", 8, 2**32 - 1), (b"stsz", 4, 0), (b"stco", 8, 2**32 - 1), (b"stts", 8, 3), (b"mdhd", 20, 0)):
        b = bytearray(WHOLE)
        i = WHOLE.index(name) + 4 + at
        b[i : i + 4] = struct.pack(">I", new)
        cases.append(bytes(b))
    for c in cases:
        x, t = media.describe(c)
        assert x == {"error": "ContainerError"} and t is None


def fragmented():
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"mp4a", bytes(28))), full(b"stts", bytes(4)), full(b"stsc", bytes(4)), full(b"stsz", bytes(8)), full(b"stco", bytes(4)))

    def trak(n):
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0), bytes(4)), full(b"hdlr", struct.pack(">4x4s12x", b"vide"), b"\0"), box(b"minf", stbl))
        return box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, n, 0, 0), bytes(60)), mdia)

    trex = [full(b"trex", struct.pack(">5I", *x)) for x in ((1, 1, 10, 5, 0x10000), (2, 1, 7, 0, 0))]

    def moof(offset):
        one = box(b"traf", full(b"tfhd", struct.pack(">I", 1), flags=0x20000), full(b"trun", struct.pack(">IiI", 3, offset, 0), flags=0x5))
        two = box(b"traf", full(b"tfhd", struct.pack(">I", 2), flags=0x20000), full(b"trun", struct.pack(">Ii4I", 2, offset + 15, 9, 4, 9, 6), flags=0x301))
        return box(b"moof", full(b"mfhd", struct.pack(">I", 1)), one, two)

    return box(b"moov", trak(1), trak(2), box(b"mvex", *trex)), moof, bytes(range(25))


def test_fragments_and_all_tracks():
    moov, moof, data = fragmented()
    media_bytes = (moov + moof(len(moof(0)) + 8) + box(b"mdat", data)) + moof(len(moof(0)) + 8) + box(b"mdat", data[::-1])
    one, two = media.read_container(media_bytes)
    assert media.sample_bytes(media_bytes, one) == data[:15] + data[::-1][:15] and media.sample_bytes(media_bytes, two) == data[15:] + data[::-1][15:]
    assert one.keys.tolist() == [0, 3] and one.duration == 60 and two.keys.tolist() == [0, 1, 2, 3] and two.duration == 36
    x, _ = media.describe(media_bytes)
    assert [t["n_samples"] for t in x["tracks"]] == [6, 4] and x["codec"] == "mp4a" and re.match(r"vide/mp4a scale=1000 duration=60 samples=6 keyframes=2 ", media.feature_text(x))


@pytest.mark.parametrize("cut", [1, 9, 40, 200])
def test_cut_fragments(cut):
    moov, moof, data = fragmented()
    whole = moov + moof(len(moof(0)) + 8) + box(b"mdat", data)
    assert media.describe(whole[:-cut])[0] == {"error": "ContainerError"}


def test_columns(spark):
    rows = [(1, WHOLE, "a"), (1, WHOLE, "a"), (2, b"junk", None), (None, None, "b")]
    got = media.media_features(spark.createDataFrame(rows, "id long, media binary, features string")).collect()
    assert [r.features.error for r in got] == [None, None, "ContainerError", "ContainerError"] and len(got[0].features.tracks) == 1 and got[2].features.tracks is None
