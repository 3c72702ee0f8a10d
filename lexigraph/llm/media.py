"""Media columns: ISO media containers, read by their boxes and sample tables.

``write_container`` stores a payload losslessly as 8-bit PCM samples of one
audio track; ``read_container`` walks the nested boxes, decodes the sample
tables (stts, stsc, stsz, stco or co64, stss) and the runs of movie fragments
(trex, tfhd, trun) of every track, and returns codec, time scale, duration and
the byte ranges of samples and key frames, reading no payload. Boxes are walked
without recursion, no deeper than ``MAX_DEPTH``; every count is checked against
the file's size before anything is allocated by it.

Defined results: a null text is an empty one; a null or broken container, however
it is broken, gives null features with the error's name in ``error``; repeated
rows give repeated rows. An empty text is 64 zero bytes; a very long one has more
samples, and its sample tables are held whole, its samples once. No rows give no
rows. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

UNIT = 64  # bytes of a sample's frame, and what payloads are padded to
TIMESCALE = 8000  # 8-bit samples a second
FRAMES_PER_CHUNK = 1024
KEY_EVERY = 256  # one sync frame in so many
MAX_DEPTH = 32  # of boxes within boxes
#: Boxes that hold boxes, and the bytes of their own fields before those.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"stsd": 8, b"dref": 8, b"meta": 4}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class ContainerError(ValueError):
    """The bytes are not a container that this reader understands."""


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of UNIT; and their
    number without the padding."""
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes, frame: int = UNIT, timescale: int = TIMESCALE) -> bytes:
    """frame must divide the payload's length."""
    frames, rest = divmod(len(payload), frame)
    if rest:
        raise ContainerError("the payload is not whole frames")
    chunks, last = divmod(frames, FRAMES_PER_CHUNK)
    chunks, last = (chunks + 1, last) if last else (chunks, FRAMES_PER_CHUNK)
    runs = [(1, FRAMES_PER_CHUNK, 1)] if chunks > 1 else []
    if not runs or last != FRAMES_PER_CHUNK:
        runs.append((chunks, last, 1))
    entry = struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, timescale << 16)
    wide = len(payload) + 16 >= 1 << 32
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=">u8") * (FRAMES_PER_CHUNK * frame)
        keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", entry)),
            _full(b"stts", struct.pack(">III", 1, frames, frame)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", struct.pack(">II", frame, frames)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        length = len(payload)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, timescale, length, 0x55C4, 0), version=1), _full(b"hdlr", struct.pack(">4x4s12x", b"soun"), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ8xhhhH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, timescale, length, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    data = _box(b"mdat", payload)
    first = len(head) + len(moov(0)) + len(data) - len(payload)
    return head + moov(first) + data


@dataclass
class Track:
    """One track: samples in order, the fragments' after the sample tables'."""

    handler: str
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray  # sample numbers from 0

    @property
    def key_ranges(self) -> list[tuple[int, int]]:
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist(), strict=True))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """Each box in [start, end): its path, where it and its body begin, and where
    it ends; a box before those within it."""
    open_boxes: list[tuple[tuple[bytes, ...], int, int]] = [((), start, end)]
    while open_boxes:
        path, start, end = open_boxes.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ContainerError("a box's header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ContainerError("a box's long size is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ContainerError(f"box {kind!r} leaves its parent")
        yield (*path, kind), start, body, stop
        open_boxes.append((path, stop, end))
        if kind in CONTAINERS:
            if len(path) == MAX_DEPTH:
                raise ContainerError(f"boxes are nested deeper than {MAX_DEPTH}")
            open_boxes.append(((*path, kind), body + CONTAINERS[kind], stop))


def _table(data: memoryview, at: int, end: int, kind: str, columns: int = 1, skip: int = 0) -> np.ndarray:
    n = struct.unpack_from(">I", data, at + 4 + skip)[0]
    if at + 8 + skip + n * columns * np.dtype(kind).itemsize > end:
        raise ContainerError("a sample table leaves its box")
    return np.frombuffer(data, kind, n * columns, at + 8 + skip).astype(np.int64).reshape(n, columns)


def _need(holds: bool, what: str) -> None:
    if not holds:
        raise ContainerError(what)


def _in_file(offsets: np.ndarray, sizes: np.ndarray, length: int) -> None:
    if len(offsets):
        _need(offsets.min() >= 0 and offsets.max() <= length and (offsets + sizes).max() <= length, "samples leave the file")


def _sample_tables(data: memoryview, found: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Offsets, sizes and key numbers of a track's sample tables, and its ticks."""
    lacking = {b"stts", b"stsc", b"stsz"} - found.keys()
    _need(not lacking and bool({b"stco", b"co64"} & found.keys()), f"a track lacks {sorted(lacking) or 'chunk offsets'}")
    at, end = found[b"stsz"]
    size, n = struct.unpack_from(">II", data, at + 4)
    _need(n * max(size, 1) <= len(data), "stsz claims more than the file holds")
    sizes = np.full(n, size, np.int64) if size else _table(data, at, end, ">u4", skip=4)[:, 0]
    times = _table(data, *found[b"stts"], ">u4", 2)
    _need(times[:, 0].sum() == n, "stts and stsz disagree")
    chunks = _table(data, *found[b"co64"], ">u8")[:, 0] if b"co64" in found else _table(data, *found[b"stco"], ">u4")[:, 0]
    _need(not len(chunks) or chunks.min() >= 0 and chunks.max() <= len(data), "chunks leave the file")
    runs = _table(data, *found[b"stsc"], ">u4", 3)
    spans = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    whole = bool((spans > 0).all()) and runs[0, 0] == 1 if len(runs) else not len(chunks)
    _need(whole and (spans * runs[:, 1]).sum() == n, "stsc, stco and stsz disagree")
    per_chunk = np.repeat(runs[:, 1], spans)
    begins = np.cumsum(per_chunk) - per_chunk
    before = np.cumsum(sizes) - sizes
    # A chunk without samples begins nowhere.
    firsts = before[np.minimum(begins, n - 1)] if n else np.zeros(len(chunks), np.int64)
    offsets = np.repeat(chunks - firsts, per_chunk) + before
    _in_file(offsets, sizes, len(data))
    keys = _table(data, *found[b"stss"], ">u4")[:, 0] - 1 if b"stss" in found else np.arange(n)
    _need(not len(keys) or keys.min() >= 0 and keys.max() < n and bool((np.diff(keys) > 0).all()), "stss names samples that there aren't")
    return offsets, sizes, keys, int((times[:, 0] * times[:, 1]).sum())


#: Flags of tfhd and trun: which fields follow.
BASE, DESCRIPTION, DURATION, SIZE, FLAGS, FROM_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
RUN_OFFSET, RUN_FIRST, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NOT_SYNC = 0x10000


def _fields(data: memoryview, at: int, end: int, flags: int, known: list[tuple[int, str]]) -> tuple[dict[int, int], int]:
    """The optional fields that flags announce, and where they end."""
    out = {}
    for flag, kind in known:
        if flags & flag:
            _need(at + struct.calcsize(kind) <= end, "a fragment's fields are cut off")
            out[flag] = struct.unpack_from(kind, data, at)[0]
            at += struct.calcsize(kind)
    return out, at


def _run(data: memoryview, at: int, end: int, base: int, usual: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """One trun: offsets, sizes, which are key frames, ticks, and where its data ends."""
    flags, n = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF, struct.unpack_from(">I", data, at + 4)[0]
    head, at = _fields(data, at + 8, end, flags, [(RUN_OFFSET, ">i"), (RUN_FIRST, ">I")])
    names = [f for f in (RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT) if flags & f]
    _need(at + 4 * n * len(names) <= end and n <= len(data), "a run leaves its box")
    rows = np.frombuffer(data, ">u4", n * len(names), at).astype(np.int64).reshape(n, len(names))
    column = lambda flag, default: rows[:, names.index(flag)] if flag in names else np.full(n, default, np.int64)
    sizes = column(RUN_SIZE, usual.get(SIZE, 0))
    marks = column(RUN_FLAGS, usual.get(FLAGS, 0)).copy()
    if n and RUN_FIRST in head and RUN_FLAGS not in names:
        marks[0] = head[RUN_FIRST]
    start = base + head.get(RUN_OFFSET, 0)
    offsets = start + np.cumsum(sizes) - sizes
    _in_file(offsets, sizes, len(data))
    return offsets, sizes, marks & NOT_SYNC == 0, int(column(RUN_DURATION, usual.get(DURATION, 0)).sum()), start + int(sizes.sum())


class _Fragments:
    """The samples of movie fragments, by track."""

    def __init__(self, data: memoryview):
        self.data, self.usual, self.found = data, {}, {}
        self.moof = self.after = 0
        self.track, self.base, self.own = 0, 0, {}

    def trex(self, at: int) -> None:
        track, _, duration, size, flags = struct.unpack_from(">5I", self.data, at + 4)
        self.usual[track] = {DURATION: duration, SIZE: size, FLAGS: flags}

    def begin(self, moof: int) -> None:
        self.moof = self.after = moof

    def tfhd(self, at: int, end: int) -> None:
        flags, self.track = struct.unpack_from(">I", self.data, at)[0] & 0xFFFFFF, struct.unpack_from(">I", self.data, at + 4)[0]
        given, _ = _fields(self.data, at + 8, end, flags, [(BASE, ">Q"), (DESCRIPTION, ">I"), (DURATION, ">I"), (SIZE, ">I"), (FLAGS, ">I")])
        self.own = self.usual.get(self.track, {}) | given
        self.base = given.get(BASE, self.moof if flags & FROM_MOOF else self.after)
        _need(self.base <= len(self.data), "a fragment's data leaves the file")
        self.first = True

    def trun(self, at: int, end: int) -> None:
        # A run without an offset follows the one before it.
        begin = self.base if self.first or struct.unpack_from(">I", self.data, at)[0] & RUN_OFFSET else self.after
        *run, self.after = _run(self.data, at, end, begin, self.own)
        self.first = False
        self.found.setdefault(self.track, []).append(run)


def _read(data: memoryview) -> list[Track]:
    tracks: list[tuple[dict[bytes, tuple[int, int]], list[str]]] = []
    fragments = _Fragments(data)
    for path, start, body, end in boxes(data, 0, len(data)):
        kind = path[-1]
        if kind == b"trak":
            tracks.append(({}, []))
        elif b"trak" in path:
            if path[-2] == b"stsd":
                tracks[-1][1].append(kind.decode("latin-1"))
            tracks[-1][0].setdefault(kind, (body, end))
        elif path[-2:] == (b"mvex", b"trex"):
            fragments.trex(body)
        elif kind == b"moof":
            fragments.begin(start)
        elif path[-2:] == (b"traf", b"tfhd"):
            fragments.tfhd(body, end)
        elif path[-2:] == (b"traf", b"trun"):
            fragments.trun(body, end)
    _need(bool(tracks), "no track")
    out = []
    for found, codecs in tracks:
        lacking = {b"tkhd", b"mdhd", b"hdlr"} - found.keys()
        _need(not lacking, f"a track lacks {sorted(lacking)}")
        at = found[b"tkhd"][0]
        number = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
        at = found[b"mdhd"][0]
        scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        _need(scale > 0 and duration < 1 << 63, "a track has no time scale")
        handler = bytes(data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12]).decode("latin-1")
        offsets, sizes, keys, ticks = _sample_tables(data, found)
        runs = fragments.found.get(number, [])
        before = len(sizes) + np.cumsum([0, *(len(r[0]) for r in runs)])
        keys = np.concatenate([keys, *(np.flatnonzero(r[2]) + n for r, n in zip(runs, before, strict=False))])
        whole = ticks + sum(r[3] for r in runs)
        out.append(Track(handler, codecs[0] if codecs else "", scale, whole if runs else int(duration or whole), np.concatenate([offsets, *(r[0] for r in runs)]), np.concatenate([sizes, *(r[1] for r in runs)]), keys.astype(np.int64)))
    return out


def read_container(media: bytes) -> list[Track]:
    """All tracks. Whatever is wrong with the bytes is a ContainerError."""
    try:
        return _read(memoryview(media))
    except (struct.error, ValueError, IndexError, KeyError, ArithmeticError, MemoryError) as e:
        raise e if isinstance(e, ContainerError) else ContainerError(f"{type(e).__name__}: {e}") from e


def sample_bytes(media: bytes, track: Track) -> bytes:
    """The track's samples in order. Neighbours are copied as one range."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    cuts = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    starts, stops = track.offsets[np.append(0, cuts)], ends[np.append(cuts - 1, len(ends) - 1)]
    return b"".join(media[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        made = [(write_container(p), n) for p, n in map(payload_of, b["text"].to_pylist())]
        yield pa.RecordBatch.from_arrays([b["id"], pa.array([n for _, n in made], pa.int64()), pa.array([m for m, _ in made], pa.binary())], ["id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_bytes and media: each whole text in a container."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_store, "id long, n_bytes long, media binary")


_TRACK = "handler:string,codec:string,timescale:long,duration:long,n_samples:long,keyframes:array<struct<offset:long,length:long>>"
FEATURES = f"{_TRACK},error:string,tracks:array<struct<{_TRACK}>>"
_TRACK_TYPES = [("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))]
_TYPES = pa.struct([*_TRACK_TYPES, ("error", pa.string()), ("tracks", pa.list_(pa.struct(_TRACK_TYPES)))])


def describe(media: bytes | None) -> tuple[dict, Track | None]:
    """The first track's features, and all tracks' as tracks; and the first track."""
    try:
        found = read_container(media or b"")
    except ContainerError as e:
        return {"error": type(e).__name__}, None
    each = [{"handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "keyframes": [{"offset": a, "length": b} for a, b in t.key_ranges]} for t in found]
    return each[0] | {"tracks": each}, found[0]


def feature_text(x: dict) -> str:
    """Features in one line; key frames as their number and a digest of their ranges."""
    if x.get("error"):
        return f"error={x['error']}"
    ranges = ",".join(f"{k['offset']}+{k['length']}" for k in x["keyframes"])
    return f"{x['handler']}/{x['codec'].strip()} scale={x['timescale']} duration={x['duration']} samples={x['n_samples']} keyframes={len(x['keyframes'])} ranges={hashlib.sha256(ranges.encode()).hexdigest()[:16]}"


def media_features(df: DataFrame, media_col: str = "media", out: str = "features") -> DataFrame:
    """df with a struct of the first track's features and of all tracks'; payloads
    stay undecoded. A column of that name is replaced."""
    kept = [n for n in df.columns if n != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = pa.array([describe(m.as_py())[0] for m in b[media_col]], _TYPES)
            yield pa.RecordBatch.from_arrays([*[b[n] for n in kept], found], [*kept, out])

    types = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join([*[f"`{n}` {types[n]}" for n in kept], f"`{out}` struct<{FEATURES}>"]))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        rows = []
        for n, m in zip(b["n_bytes"].to_pylist(), b["media"], strict=True):
            media = m.as_py()
            x, track = describe(media)
            back = sample_bytes(media, track)
            keys = x["keyframes"]
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(x), x["codec"], x["duration"] / x["timescale"], len(keys), keys[0]["offset"], keys[-1]["offset"] + keys[-1]["length"]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([b["id"], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["id", *DIGEST])


DIGEST = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "seconds", "keyframes", "first_key_offset", "last_key_end"]


def media_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text, reads the stored bytes back, and returns digests."""
    out = store_texts(docs, id_col, text_col).mapInArrow(
        _verify, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, seconds double, keyframes long, first_key_offset long, last_key_end long"
    )
    return out.withColumnRenamed("id", id_col)
