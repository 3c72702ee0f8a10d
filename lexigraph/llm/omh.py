"""Document fingerprints by Order MinHash, sensitive to edit distance.

Each k-mer of code points is numbered by its occurrence in the text. For each of
``m`` hash functions the ``l`` numbered k-mers with the least hashes are taken,
put back into text order, and hashed as a tuple. Likeness is the share of equal
entries of two signatures; unlike a plain MinHash it falls when the order of
what two texts share differs.

The next document's opening is needed to edit a document. Documents are dealt to
ranges of doc_id; the first row of each range is sent to the range before it as
well, so every task sees its successors without a global sort in one task.

Defined results: a null text is an empty one; a text without k-mers is one
k-mer, and an empty text has none, with a signature of its own; fewer than ``l``
k-mers make a shorter tuple. Null ids come last, rows with equal ids order by
text; rows of one id, and all null ids, are in one range and so in one task. Of equal
hashes the earlier k-mer is taken. No rows give no rows. Other columns of the input
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

K, L, M = 16, 2, 32
#: Hash values below this multiple of l / n are looked at before all are.
SLACK = 12
BLOCK = 1 << 22
U = np.uint64
MIX1, MIX2, STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
BASE = 0x100000001B3
NONE = U(0x6A09E667F3BCC908)
np.seterr(over="ignore")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each window of k codes; one for all of a shorter text."""
    if not len(codes):
        return np.empty(0, np.uint64)
    h, width, power = mix(codes.astype(np.uint64) + STEP), 1, BASE
    k = min(k, len(codes))
    done, have, out = k, 0, None
    while True:  # windows of doubling width, joined by the bits of k
        if done & width:
            out = h if out is None else h[: len(h) - have] * U(pow(BASE, have, 1 << 64)) + out[width:][: len(h) - have] if have else h
            have += width
        if have == k:
            return mix(out[: len(codes) - k + 1])
        h = h[: len(h) - width] * U(power) + h[width:]
        width, power = width * 2, power * power % (1 << 64)


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, occurrence); the first occurrence keeps the k-mer's own."""
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return h
    hint = np.zeros(1 << 16, bool)
    hint[(twice & U(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(hint[(h & U(0xFFFF)).astype(np.int64)])
    order = at[np.argsort(h[at], kind="stable")]
    v = h[order]
    first = np.append(True, v[1:] != v[:-1])
    begin = np.flatnonzero(first)
    nth = np.arange(len(v)) - np.repeat(begin, np.diff(np.append(begin, len(v))))
    again = nth > 0
    h = h.copy()
    h[order[again]] = mix(v[again] + nth[again].astype(np.uint64) * STEP)
    return h


def _multipliers(m: int) -> np.ndarray:
    return mix(np.arange(1, m + 1, dtype=np.uint64) * STEP) | U(1)


def _scores(h: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Each function's hashes of h. A product's high bits depend on all of h's."""
    return h[None, :] * a[:, None]


def candidates(h: np.ndarray, l: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    """(function, place, hash) of all numbered k-mers that can be among a
    function's l least: those below a threshold that all functions have l under."""
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    a, width = _multipliers(m), max(1, BLOCK // m)
    share = min(1.0, (l + SLACK) / len(h))
    while True:
        most = U(min((1 << 64) - 1, int(share * 2.0**64)))
        found = []
        for begin in range(0, len(h), width):
            v = _scores(h[begin : begin + width], a)
            f, p = np.nonzero(v <= most) if share < 1 else np.divmod(np.arange(v.size), v.shape[1])
            found.append((f, p + begin, v[f, p]))
        f, p, v = (np.concatenate(x) for x in zip(*found, strict=True))
        if share >= 1 or np.bincount(f, minlength=m).min() >= l:
            return f, p, v
        share = min(1.0, share * 4)


def least(f: np.ndarray, p: np.ndarray, v: np.ndarray, h: np.ndarray, l: int, m: int) -> np.ndarray:  # noqa: E741
    """The signature: tuples of each function's l least, in text order."""
    out = np.full(m, NONE, np.uint64)
    if not len(f):
        return out
    order = np.lexsort((p, v, f))
    f, p = f[order], p[order]
    begin = np.searchsorted(f, np.arange(m))
    rank = np.arange(len(f)) - begin[f]
    f, p = f[rank < l], p[rank < l]
    order = np.lexsort((p, f))
    f, p = f[order], p[order]
    begin, end = np.searchsorted(f, np.arange(m)), np.searchsorted(f, np.arange(m), side="right")
    for i in range(l):
        has = begin + i < end
        out[has] = mix(out[has] * STEP + h[p[(begin + i)[has]]])
    return out


def signature(text: str, k: int = K, l: int = L, m: int = M) -> np.ndarray:  # noqa: E741
    h = numbered(kmer_hashes(_codes(text), k))
    return _short(least(*candidates(h, l, m), h, l, m), m)


def signatures(text: str, edited: str, same: int, k: int = K, l: int = L, m: int = M) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Of two texts whose first same code points are the same: the k-mers within
    those are hashed, numbered and compared once."""
    one, two = kmer_hashes(_codes(text), k), kmer_hashes(_codes(edited), k)
    one, two = numbered(one), numbered(two)
    shared = max(0, same - k + 1)
    if shared < 1 or len(one) < shared or len(two) < shared:
        return tuple(_short(least(*candidates(h, l, m), h, l, m), m) for h in (one, two))
    # Any l of a text's k-mers that are its least are under a threshold that l of the shared ones are under.
    both = np.concatenate([one, two[shared:]])
    f, p, v = candidates(both[: len(one)], l, m)
    mine = least(f, p, v, one, l, m)
    head = p < shared
    if np.bincount(f[head], minlength=m).min() < l:
        return _short(mine, m), _short(least(*candidates(two, l, m), two, l, m), m)
    most = v.max()
    tail = _scores(two[shared:], _multipliers(m)) if len(two) * m <= BLOCK else None
    if tail is None:
        return _short(mine, m), _short(least(*candidates(two, l, m), two, l, m), m)
    g, q = np.nonzero(tail <= most)
    f2, p2, v2 = np.concatenate([f[head], g]), np.concatenate([p[head], q + shared]), np.concatenate([v[head], tail[g, q]])
    return _short(mine, m), _short(least(f2, p2, v2, two, l, m), m)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _short(x: np.ndarray, m: int) -> np.ndarray:
    return (x >> U(32)).astype(">u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edit(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter replaced by as much of the next one's
    beginning, or all of it; and the code points both begin with."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n], len(text) - n


FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _edits(k: int, l: int, m: int):  # noqa: E741
    """Rows come by (range, id, text); one of the next range's rows ends each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, id, text) that waits for its successor
        waiting = None  # the finished part of the row before held
        for b in sliced(batches):
            out = []
            for at, doc, text, guest in zip(*[b[c].to_pylist() for c in ("range", "doc", "text", "guest")], strict=True):
                if held is not None and held[0] != at:
                    raise ValueError("a range ended without its successor")
                if held is not None:
                    edited, same = edit(held[2], text)
                    fp, fp_edited = signatures(held[2], edited, same, k, l, m)
                    if waiting is not None:
                        out.append((*waiting, likeness(waiting[-1], fp)))
                    waiting = (held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), fp_edited, fp)
                if guest:
                    out.append((*waiting, likeness(waiting[-1], signature(text, k, l, m))))
                    held = waiting = None
                else:
                    held = (at, doc, text)
            rows = [(doc, n, sha, fp.tobytes().hex(), e.tobytes().hex(), likeness(fp, e), near) for doc, n, sha, e, fp, near in out]
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[t for _, t in FIELDS]], strict=True)], ["doc", *[n for n, _ in FIELDS]])

    return run


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, l: int = L, m: int = M, rows_per_range: int = 2_000) -> DataFrame:  # noqa: E741
    """Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next, a row for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("doc")
    n = ids.count()
    ranges = max(1, min(20_000, -(-n // rows_per_range)))
    # Range limits: at most 20,000 numbers. They need not be exact, only the same for all rows.
    cuts = sorted(set(map(int, ids.stat.approxQuantile("doc", [i / ranges for i in range(1, ranges)], 0.1 / ranges)))) if ranges > 1 else []
    limits = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def spot(doc: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, doc.to_numpy(np.int64), side="right").astype(np.int32))

    known = F.coalesce("doc", F.lit((1 << 63) - 1))
    rows, ids = rows.withColumn("range", spot(known)), ids.withColumn("range", spot(known))
    # The first id of each range: at most one for each range, so at most 20,001.
    firsts = sorted((r["range"], r["doc"]) for r in ids.groupBy("range").agg(F.min("doc").alias("doc")).collect())
    heads = docs.sparkSession.createDataFrame([(at, doc, firsts[i - 1][0]) for i, (at, doc) in enumerate(firsts)], "at int, head long, into int")
    at_head = rows.join(F.broadcast(heads), (rows["range"] == heads["at"]) & rows["doc"].eqNullSafe(heads["head"]))
    guests = at_head.groupBy("into", "doc").agg(F.min("text").alias("text")).select(F.col("into").alias("range"), "doc", "text", F.lit(True).alias("guest"))
    every = rows.select("range", "doc", "text", F.lit(False).alias("guest")).unionByName(guests)
    dealt = every.repartition("range").sortWithinPartitions("range", "guest", F.col("doc").asc_nulls_last(), "text")
    return dealt.mapInArrow(_edits(k, l, m), "doc long, " + ", ".join(f"{n} {'double' if t == pa.float64() else 'long' if t == pa.int64() else 'string'}" for n, t in FIELDS)).withColumnRenamed("doc", id_col)
