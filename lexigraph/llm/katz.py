"""Language-model scores by Katz backoff over word bigrams.

    P(w | v) = d(c) c(v w) / c(v)      for kept bigrams (c >= min_count)
             = alpha(v) P(w)           for all others
    P(w)     = d(c) c(w) / N           for known words; the rest of the mass is
                                       that of any unknown word

The discounts d are Good-Turing's as Katz scales them for counts up to
``GT_MAX``. Every bigram is kept unless a min_count above 1 is asked for; with one,
rarer ones leave their mass to the backoff.
alpha(v) = (1 - mass of v's kept bigrams) / (1 - P of their words) makes each
context's distribution sum to one exactly. A context without mass left for
others has its kept counts scaled by c / (c + 1/2).

Counting and scoring cover the whole corpus in tables dealt to ``parts`` by the
word, so that a word's count and probability are at hand where its bigrams are.
Words so frequent that they would fill a quarter of a part are dealt by the
whole bigram; there are at most 4 x parts of them, and only their counts are
sent to all tasks. Which words those are is read from a sample of documents: it
decides where bigrams are counted, not what is counted. Tasks send packed
arrays: each distinct bigram of a batch of documents once, with the documents it
occurs in. A document's score is the sum of its backoff terms, word by word, plus
what kept bigrams differ from those. What a bigram's first word adds is not joined
with the bigrams: each part asks the part of each of its first words once, in
packed arrays, and is answered in the same order.

Defined results: a null text is an empty one, scored by its end token; without
training rows every token is unknown and scores 0; a null id trains; repeated
rows count and are scored each. Other columns of the input are not read.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, sliced, trim

MIN_COUNT, GT_MAX = 1, 5
#: Bytes of training text for each part; bytes of the sample that names frequent words.
PART_BYTES, SAMPLE_BYTES = 16_000_000, 8_000_000
BATCH_TOKENS, BATCH_DOCS = 1_500_000, 60_000
#: Hashes that stand for the end of a text and for what precedes its first word.
END, START = 0, 1
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U = np.uint64
SHIFT = 33


def training_row(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 != 0, F.lit(True))


class _Hashes(dict):
    """Word to its 64-bit hash; forgets when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = max(2, xxhash.xxh64_intdigest(word, 10))
        return h


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def _tokens(text: str | None, hashes: _Hashes) -> np.ndarray:
    w = words_of(text)
    out = np.empty(len(w) + 1, np.uint64)
    out[:-1] = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    out[-1] = END
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray], list[bool]]]:
    """Documents' ids, token hashes and training marks, in bounded batches."""
    hashes, ids, tokens, train, n = _Hashes(), [], [], [], 0
    for b in sliced(batches):
        for doc, text, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), b["train"].to_pylist(), strict=True):
            x = _tokens(text, hashes)
            ids.append(doc)
            tokens.append(x)
            train.append(t)
            n += len(x)
            if n >= BATCH_TOKENS or len(ids) >= BATCH_DOCS:
                yield ids, tokens, train
                ids, tokens, train, n = [], [], [], 0
    if ids:
        yield ids, tokens, train


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, tokens, _ in _batches(batches):
        h, c = np.unique(np.concatenate(tokens), return_counts=True)
        for i in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(c[i : i + 100_000].astype(np.int64))], ["h", "c"])


def good_turing(n: dict[int, int], most: int, least: int = 1) -> dict[int, float]:
    """Discount of each count from least to most. n: how many types have count r,
    for r to most + 1. Where Good-Turing's estimate isn't in (0, 1), absolute
    discounting by n1 / (n1 + 2 n2) takes its place."""
    n1, n2 = n.get(1, 0), n.get(2, 0)
    tail = (most + 1) * n.get(most + 1, 0) / n1 if n1 else 1.0
    flat = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = {}
    for r in range(least, most + 1):
        d = ((r + 1) * n.get(r + 1, 0) / n[r] / r - tail) / (1 - tail) if n.get(r) and tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - min(flat, 0.9)) / r
    return out


def part_of(w: np.ndarray, parts: int) -> np.ndarray:
    return ((w >> U(SHIFT)) % U(parts)).astype(np.int64)


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first ^ (second * U(0x9E3779B97F4A7C15))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: those of one significance together, compressed."""
    turned = [a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(turned))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(data, "<i8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours; cumsum undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype("<u4")


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin[i], begin[i] + 1, ... count[i] of them, for each i."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - begin, count)


def _pairs(tokens: list[np.ndarray], hot: np.ndarray, parts: int):
    """Distinct bigrams of some documents in order of their parts: where each
    part begins, the first and second words, counts, and document numbers."""
    lengths = np.array([len(t) for t in tokens])
    second = np.concatenate(tokens)
    n_docs = len(tokens)
    tokens.clear()  # second has them all
    doc = np.repeat(np.arange(n_docs, dtype=np.uint16), lengths)
    order = np.argsort(second)
    run = second[order]
    new = np.append(True, run[1:] != run[:-1])
    words = np.append(run[new], U(START))
    at = np.empty(len(second), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    del run, new, order, second
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[np.cumsum(lengths) - lengths] = len(words) - 1
    key = at.astype(np.int64) * len(words) + before
    del at, before
    order = np.argsort(key)
    doc = doc[order]
    key = key[order]
    del order
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(begin, len(key))).astype(np.int32)
    # Words by their numbers, half as wide as their hashes.
    i2, i1 = (x.astype(np.int32) for x in np.divmod(key[begin], len(words)))
    del key
    part = part_of(words, parts).astype(np.int32)[i2]
    if len(hot):
        is_hot = np.isin(words, hot)[i2]
        part[is_hot] = part_of(_pair_key(words[i1[is_hot]], words[i2[is_hot]]), parts)
    by = np.argsort(part, kind="stable")
    limits = np.searchsorted(part[by], np.arange(parts + 1))
    del part
    begin, count, i1, i2 = begin[by], count[by], i1[by], i2[by]
    del by
    docs = doc[_spread(begin, count)]
    return limits, words[i1], words[i2], count, docs


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of runs of equal neighbours, and the runs' lengths."""
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return x[begin], np.diff(np.append(begin, len(x)))


def _packed_words(w1: np.ndarray, w2: np.ndarray) -> list[np.ndarray]:
    names, at = np.unique(w1, return_inverse=True)
    second, runs = _runs(w2)
    return [_steps(names.astype("<u8")), _narrow(at), _steps(second.astype("<u8")), _narrow(runs)]


def _unpacked_words(names: np.ndarray, at: np.ndarray, second: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words, and the second words of runs."""
    return np.cumsum(names, dtype=np.uint64)[at], np.cumsum(second, dtype=np.uint64)


WORDS = ("<u8", "<u4", "<u8", "<u4")


def _pack_counts(hot: np.ndarray, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, _ in _batches(batches):
            limits, w1, w2, count, _ = _pairs(tokens, hot, parts)
            for p in range(parts):
                a, b = limits[p], limits[p + 1]
                if a < b:
                    data = _pack(*_packed_words(w1[a:b], w2[a:b]), _narrow(count[a:b]))
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([data], pa.binary())], ["part", "data"])

    return run


#: Kinds of rows: kept bigrams of a part (packed, c of them); numbers of bigrams
#: (h: their count, c: how many); words (h, c); answers of the part h (packed).
PAIR, NUMBER, WORD_COUNT, ANSWER = 0, 1, 2, 3
#: A part's kept bigrams in order of their words: first words, second words, counts,
#: and the count in this part of each second word.
PAIRS = (*WORDS, "<u4", "<i8")


def _merge(min_count: int, most: int):
    def merged(part: int, found: list[bytes]) -> Iterator[pa.RecordBatch]:
        w1, w2, c = [], [], []
        while found:
            names, at, second, runs, count = _unpack(found.pop(), *WORDS, "<u4")
            first, second = _unpacked_words(names, at, second, runs)
            w1.append(first)
            w2.append(np.repeat(second, runs))
            c.append(count)
        w1 = np.concatenate(w1)
        w2 = np.concatenate(w2)
        c = np.concatenate(c)
        key = _pair_key(w1, w2)
        order = np.argsort(key)
        key = key[order]
        w1 = w1[order]
        w2 = w2[order]
        c = c[order]
        if _mixed(key, w1, w2):
            order = np.lexsort((w1, w2, key))
            w1, w2, c = w1[order], w2[order], c[order]  # equal keys stay together
        del order
        begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
        c = np.add.reduceat(c, begin, dtype=np.int64)
        del key
        w1 = w1[begin]
        w2 = w2[begin]
        n = np.bincount(np.minimum(c, most + 2), minlength=most + 3)[1 : most + 2]
        yield _columns(part, NUMBER, np.arange(1, most + 2), n)
        order = np.lexsort((w1, w2))
        w1 = w1[order]
        w2 = w2[order]
        c = c[order]
        del order
        start = np.flatnonzero(np.append(True, w2[1:] != w2[:-1]))
        words, total = w2[start], np.add.reduceat(c, start)
        for i in range(0, len(words), 100_000):
            yield _columns(part, WORD_COUNT, words[i : i + 100_000].view(np.int64), total[i : i + 100_000])
        if min_count > 1:
            keep = np.flatnonzero(c >= min_count)
            w1, w2, c = w1[keep], w2[keep], c[keep]
        if len(c):
            of = total[np.searchsorted(words, _runs(w2)[0])]
            yield _columns(part, PAIR, None, [len(c)], _pack(*_packed_words(w1, w2), _narrow(c), of.astype("<i8")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, []
        for b in batches:
            for part, data in zip(b["part"].to_pylist(), b["data"].to_pylist(), strict=True):
                if part != at and found:
                    yield from merged(at, found)
                    found = []
                at = part
                found.append(data)
        if found:
            yield from merged(at, found)

    return run


def _mixed(key: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> bool:
    """Whether different bigrams share a key somewhere."""
    return bool(((key[1:] == key[:-1]) & ((w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]))).any())


KEPT = ["part", "kind", "h", "c", "data"]


def _columns(part: int, kind: int, h, c, data: bytes | None = None) -> pa.RecordBatch:
    h = pa.nulls(len(c), pa.int64()) if h is None else pa.array(h, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part, np.int64)), pa.array(np.full(len(c), kind, np.int32)), h, pa.array(c, pa.int64()), pa.array([data] * len(c), pa.binary())], KEPT)


def _discount(c: np.ndarray, discounts: dict[int, float]) -> np.ndarray:
    d = np.ones(len(c))
    for r, x in discounts.items():
        d[c == r] = x
    return d * c


def _kept(data: bytes, num: dict, totals: tuple[np.ndarray, np.ndarray]):
    """A part's kept bigrams: distinct first words and each bigram's place in
    them, second words, discounted counts, and P of the second words. totals has
    the counts of words that are counted in several parts."""
    names, at, second, runs, c, of = _unpack(data, *PAIRS)
    names, second = _unpacked_words(names, slice(None), second, runs)
    place, there = _find(totals[0], second)
    if there.any():
        of = np.where(there, totals[1][place], of)
    p1 = _discount(of, num["d1"]) * (num["scale"] / max(num["n"], 1))
    return names, at, np.repeat(second, runs), _discount(c, num["d2"]), np.repeat(p1, runs)


def _by_home(names: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The parts of some words, and the places of each one's."""
    home = part_of(names, parts)
    order = np.argsort(home, kind="stable")
    limits = np.searchsorted(home[order], np.arange(parts + 1))
    for p in np.unique(home).tolist():
        yield p, order[limits[p] : limits[p + 1]]


def _ask(num: dict, totals: tuple[np.ndarray, np.ndarray], parts: int):
    """What a part's kept bigrams say of their first words, to those words' parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data in zip(b["part"].to_pylist(), b["data"], strict=True):
                names, at, _, c, p1 = _kept(data.as_py(), num, totals)
                mass, covered = np.bincount(at, c, len(names)), np.bincount(at, p1, len(names))
                for home, k in _by_home(names, parts):
                    data = _pack(_steps(names[k].astype("<u8")), mass[k], covered[k])
                    yield pa.RecordBatch.from_arrays([pa.array([home], pa.int64()), pa.array([part], pa.int64()), pa.array([data], pa.binary())], ["home", "part", "data"])

    return run


CONTEXTS = "part long, kind int, h long, c long, back double, data binary"


def _contexts(asked: pa.Table, words: pa.Table) -> pa.Table:
    """back of a part's words, and for the parts that ask lead - back: lead is log10 of
    the scale of a word's kept counts / its own."""
    h, first = np.unique(words["h"].to_numpy().view(np.uint64), return_index=True)
    c = words["c"].to_numpy()[first]
    mass, covered, places = np.zeros(len(h)), np.zeros(len(h)), []
    for data in asked["data"]:
        names, m, p = _unpack(data.as_py(), "<u8", "<f8", "<f8")
        at = np.searchsorted(h, np.cumsum(names, dtype=np.uint64)).astype(np.uint32)
        mass[at] += m
        covered[at] += p
        places.append(at)
    over = np.where(mass > c - 1e-6, c + 0.5, c)
    lead = -np.log10(over)
    back = np.log10((1 - mass / over) / (1 - covered))
    home = (words["part"] if words.num_rows else asked["home"])[0].as_py()
    n, k = len(h), len(places)
    out = [
        pa.array(np.append(np.full(n, home, np.int64), asked["part"].to_numpy())), pa.array(np.repeat([WORD_COUNT, ANSWER], [n, k]).astype(np.int32)),
        pa.array(np.append(h.view(np.int64), np.full(k, home, np.int64))), pa.array(np.append(c, np.zeros(k, np.int64))),
        pa.array(np.append(back, np.zeros(k))), pa.array([None] * n + [_pack((lead - back)[at]) for at in places], pa.binary()),
    ]
    trim()
    return pa.table(out, ["part", "kind", "h", "c", "back", "data"])


def _gains(model: pa.Table, num: dict, totals: tuple[np.ndarray, np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A part's kept bigrams, and what their log10 probability differs from their
    backoff's."""
    kinds = model["kind"].to_numpy()
    packed = np.flatnonzero(kinds == PAIR).tolist()
    if not packed:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0)
    names, at, w2, c, p1 = _kept(model["data"][packed[0]].as_py(), num, totals)
    answers = {model["h"][i].as_py(): i for i in np.flatnonzero(kinds == ANSWER).tolist()}
    more = np.empty(len(names))
    for home, k in _by_home(names, parts):
        more[k] = _unpack(model["data"][answers[home]].as_py(), "<f8")[0]
    return names[at], w2, np.log10(c) + more[at] - np.log10(p1)


class KatzModel:
    """The tables of a model: words (part, h, c, back), packed (of each part, its
    words, bigrams and answers), bigrams (part, w1, w2, gain), and a few numbers.

    back is log10 alpha of the word as a context; gain is what a kept bigram's log10 probability differs from its backoff's.
    """

    start_back = 0.0

    def __init__(self, rows: DataFrame, part_bytes: int = PART_BYTES, min_count: int = MIN_COUNT, most: int = GT_MAX):
        spark = rows.sparkSession
        train = rows.where("train")
        size = int(train.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0)
        self.parts = parts = max(1, -(-size // part_bytes))
        self.hot = self._frequent(train, size)
        hot = spark.createDataFrame([(_signed(int(h)),) for h in self.hot], "h long")

        counts = train.mapInArrow(lean(_pack_counts(self.hot, parts)), "part long, data binary").repartition(parts, "part").sortWithinPartitions("part")
        merged = materialise(counts.mapInArrow(lean(_merge(min_count, most)), "part long, kind int, h long, c long, data binary"), "lm-counts")
        del counts
        _release(spark)
        # A word is counted in one part, but for the frequent ones.
        counted = merged.where(F.col("kind") == WORD_COUNT).select("h", "c")
        among = lambda df, how: df.join(F.broadcast(hot), "h", how)  # noqa: E731  at most 4 x parts rows
        words = among(counted, "left_anti").unionByName(among(counted, "left_semi").groupBy("h").agg(F.sum("c").alias("c"))) if len(self.hot) else counted
        first = words.agg(F.sum("c"), F.count(F.lit(1)), *[F.count_if(F.col("c") == r) for r in range(1, most + 2)]).first()
        self.n, self.v = int(first[0] or 0), int(first[1])
        d1 = self.word_discounts = good_turing({r: first[r + 1] for r in range(1, most + 2)}, most)
        freed = sum(first[r + 1] * r * (1 - x) for r, x in d1.items()) / self.n if self.n else 1.0
        # Where no word is that rare, half a token is unknown.
        self.unknown = freed or 0.5 / (self.n + 0.5)
        self.known_scale = (1 - self.unknown) / (1 - freed) if self.n else 1.0
        n2 = {r["h"]: r["n"] for r in merged.where(F.col("kind") == NUMBER).groupBy("h").agg(F.sum("c").alias("n")).collect()}
        d2 = self.pair_discounts = good_turing(n2, most, min_count)
        totals = {r["h"] % (1 << 64): r["c"] for r in among(words, "left_semi").collect()} if len(self.hot) else {}
        self.totals = np.array(sorted(totals), np.uint64), np.array([totals[h] for h in sorted(totals)], np.int64)
        kept = merged.where(F.col("kind") == PAIR)
        asked = kept.select("part", "data").mapInArrow(lean(_ask(self.numbers(), self.totals, parts)), "home long, part long, data binary")
        ends = words.where(F.col("h") == END).select(F.lit(START).cast("long").alias("h"), "c")
        mine = words.unionByName(ends).select((F.shiftrightunsigned("h", SHIFT) % parts).alias("part"), "h", "c")
        contexts = materialise(asked.groupBy("home").cogroup(mine.groupBy("part")).applyInArrow(_contexts, CONTEXTS), "lm-contexts")
        _release(spark)
        self.words = contexts.where(F.col("kind") == WORD_COUNT).select("part", "h", "c", "back")
        self.packed = contexts.select("part", "kind", "h", "c", "back", "data").unionByName(kept.withColumn("back", F.lit(0.0)))
        special = {int(r["h"]): (int(r["c"]), float(r["back"])) for r in self.words.where(F.col("h") == START).unionByName(among(self.words, "left_semi").select(*self.words.columns)).select("h", "c", "back").collect()}
        self.start_back = special.get(START, (0, 0.0))[1]
        found = [h for h in self.hot if _signed(int(h)) in special]
        self.hot_table = np.array(found, np.uint64), np.array([special[_signed(int(h))][0] for h in found], np.int64), np.array([special[_signed(int(h))][1] for h in found], np.float64)

    @property
    def bigrams(self) -> DataFrame:
        num, totals, parts = self.numbers(), self.totals, self.parts

        def run(model: pa.Table) -> pa.Table:
            w1, w2, gain = _gains(model, num, totals, parts)
            return pa.table([pa.array(np.full(len(w1), model["part"][0].as_py(), np.int64)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(gain)], ["part", "w1", "w2", "gain"])

        return self.packed.groupBy("part").applyInArrow(run, "part long, w1 long, w2 long, gain double")

    def _frequent(self, train: DataFrame, size: int) -> np.ndarray:
        """Words that would fill a quarter of a part, by a sample of documents."""
        if self.parts == 1:
            return np.empty(0, np.uint64)
        of = 1 << 20
        share = min(of, max(1, of * SAMPLE_BYTES // size))
        sample = train.where(F.pmod(F.xxhash64("id", F.lit("lm")), F.lit(of)) < share)
        counted = materialise(sample.mapInArrow(lean(_unigrams), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-sample")
        total = counted.agg(F.sum("c")).first()[0] or 0
        found = counted.where(F.col("c") * 4 * self.parts >= max(total, 1)).collect()
        return np.array(sorted(int(r["h"]) % (1 << 64) for r in found), np.uint64)

    def numbers(self) -> dict:
        return {"n": self.n, "v": self.v, "unknown": self.unknown, "scale": self.known_scale, "d1": self.word_discounts, "d2": self.pair_discounts, "start_back": self.start_back}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _release(spark) -> None:
    """Lets Spark's cleaner delete the files of finished shuffles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _pack_docs(hot: np.ndarray, parts: int):
    """For each batch: its bigrams by part with the documents they occur in; and
    in one part more the documents' ids, training marks and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (ids, tokens, train) in enumerate(_batches(batches)):
            batch = task << 32 | number
            sizes = np.array([len(t) for t in tokens], "<i8")
            limits, w1, w2, count, docs = _pairs(tokens, hot, parts)
            ends = np.append(0, np.cumsum(count))
            nulls = np.array([i is None for i in ids], np.uint8)
            about = _pack(np.array([i or 0 for i in ids], "<i8"), nulls, np.array(train, np.uint8), sizes)
            yield _blob(batch % parts, batch, 1, about)
            for p in range(parts):
                a, b = limits[p], limits[p + 1]
                if a < b:
                    yield _blob(p, batch, 0, _pack(*_packed_words(w1[a:b], w2[a:b]), _narrow(count[a:b]), docs[ends[a] : ends[b]].astype("<u2")))

    return run


def _blob(part: int, batch: int, kind: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([batch], pa.int64()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["part", "batch", "kind", "data"])


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each x in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def _score(num: dict, hot_table, totals, parts: int):
    def log_word(c: np.ndarray) -> np.ndarray:
        return np.log10(np.where(c > 0, _discount(c, num["d1"]) * num["scale"] / max(num["n"], 1), num["unknown"]))

    def run(blobs: pa.Table, model: pa.Table) -> pa.Table:
        is_word = model["kind"].to_numpy() == WORD_COUNT
        h, c, back = model["h"].fill_null(0).to_numpy().view(np.uint64)[is_word], model["c"].to_numpy()[is_word], model["back"].to_numpy()[is_word]
        h, c, back = np.append(h, hot_table[0]), np.append(c, hot_table[1]), np.append(back, hot_table[2])
        h, first = np.unique(h, return_index=True)
        c, back = c[first], back[first]
        w1, w2, gain = _gains(model, num, totals, parts)
        key = _pair_key(w1, w2)
        order = np.argsort(key)
        w1 = w1[order]
        w2 = w2[order]
        gain = gain[order]
        key = key[order]
        del order
        out = []
        for batch, kind, held in zip(blobs["batch"].to_pylist(), blobs["kind"].to_pylist(), blobs["data"], strict=True):
            data = held.as_py()  # one at a time: the column itself holds them all
            if kind:
                out.append((batch, kind, data))
                continue
            names, at, word, runs, count, docs = _unpack(data, *WORDS, "<u4", "<u2")
            a, word = _unpacked_words(names, at, word, runs)
            place, there = _find(h, word)
            n = np.where(there, c[place] if len(c) else 0, 0)
            base = np.log10((n + 0.1) / (num["n"] + 0.1 * (num["v"] + 1)))
            score = log_word(n) + np.where(there & (word != END), back[place] if len(back) else 0.0, 0.0)
            b = np.repeat(word, runs)
            score = np.repeat(score, runs)
            if len(key):
                where = np.searchsorted(key, _pair_key(a, b))
                left = np.arange(len(a))
                while len(left):  # equal keys of different bigrams follow each other
                    spot = where[left]
                    left, spot = left[spot < len(key)], spot[spot < len(key)]
                    same = key[spot] == _pair_key(a[left], b[left])
                    left, spot = left[same], spot[same]
                    hit = (w1[spot] == a[left]) & (w2[spot] == b[left])
                    score[left[hit]] += gain[spot[hit]]
                    left = left[~hit]
                    where[left] += 1
            base, known = np.repeat(base, runs), np.repeat(n > 0, runs)
            docs = docs.astype(np.int64)
            size = int(docs.max()) + 1
            sums = [np.bincount(docs, np.repeat(x, count), size) for x in (base, score, known)]
            seen = np.flatnonzero(np.bincount(docs, minlength=size))
            out.append((batch, 0, _pack(seen.astype("<u2"), sums[0][seen], sums[1][seen], _narrow(sums[2][seen]))))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        trim()
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["batch", "kind", "data"])

    return run


def _assemble(num: dict):
    def run(blobs: pa.Table) -> pa.Table:
        kinds = blobs["kind"].to_pylist()
        ids, nulls, train, tokens = _unpack(blobs["data"][kinds.index(1)].as_py(), "<i8", "u1", "u1", "<i8")
        base, score, known = np.zeros(len(ids)), np.full(len(ids), num["start_back"]), np.zeros(len(ids), np.int64)
        for kind, data in zip(kinds, blobs["data"], strict=True):
            if not kind:
                seen, b, s, k = _unpack(data.as_py(), "<u2", "<f8", "<f8", "<u4")
                base[seen] += b
                score[seen] += s
                known[seen] += k
        return pa.table(
            [pa.array(ids, pa.int64(), mask=nulls.astype(bool)), pa.array(train == 0), pa.array(tokens), pa.array(known), pa.array(np.full(len(ids), num["n"], np.int64)), pa.array(base), pa.array(score)],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, min_count: int = MIN_COUNT) -> DataFrame:
    """Learns from the training rows of docs, keeping bigrams seen min_count times
    or more, and scores all. Returns id_col,
    held_out, n_tokens, n_known, train_tokens, base_score and score."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), training_row(F.col(id_col)).alias("train"))
    model = KatzModel(rows, part_bytes, min_count)
    _release(docs.sparkSession)
    num, parts = model.numbers(), model.parts
    blobs = rows.mapInArrow(lean(_pack_docs(model.hot, parts)), "part long, batch long, kind int, data binary")
    scored = blobs.groupBy("part").cogroup(model.packed.groupBy("part")).applyInArrow(_score(num, model.hot_table, model.totals, parts), "batch long, kind int, data binary")
    out = scored.groupBy("batch").applyInArrow(_assemble(num), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
