"""Quality classifier: logistic regression over hashed word n-grams.

A text is its words and pairs of neighbouring words in three views: as they are
(letters and digits, lower-cased), by their shape (case, and what stands before
and after the letters), and by whether they repeat the word before. Each n-gram's
hash is one of 2**BITS features, valued 1 + log of how often it occurs, all scaled
to length one. Weights are trained by the follow-the-regularised-leader update
with proximal steps, one row at a time: shards of the training rows take it from
the same state in parallel, their states are averaged, and the next round goes on
from there. A score is the sparse dot product of a text's features with them.

The model is fitted on a bounded sample: SAMPLE labelled training rows at most,
those with the least hashes of their ids and texts (rows of the same id and text
count once). Its size depends on BITS alone. All else covers all rows and whole
texts; very long ones are counted in pieces of PIECE bytes, which no pair crosses.

Defined results: a null or empty text has no n-gram, and the bias's score; labels
of one id are averaged, null ones don't count; a null id is held in and never
labelled; repeated rows give repeated rows; without a labelled row every score is
0.5. A word of over PIECE bytes counts as several. Columns of the input other than
the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import FILE_BYTES
from .common import drop, lean, materialise, sliced, small_batches
from .langid import sampled

SAMPLE, BITS = 20_000, 18
SHARDS, ROUNDS = 8, 10
#: Training rows that are read together.
PACK = 256
#: Bytes of texts whose words are looked at together.
PIECE = 1 << 18
ALPHA, BETA, L1, L2 = 10.0, 1.0, 0.02, 0.0
THRESHOLD = 0.3
U = np.uint64
BASE, STEP = 0x100000001B3, U(0x9E3779B97F4A7C15)
MIX = U(0xBF58476D1CE4E5B9)
#: Of each byte: its class (0 blank, 1 other sign, 2 capital, 3 small letter, digit or part of a longer character) and itself in lower case.
CLASS = np.full(256, 3, np.uint8)
CLASS[:128] = 1
CLASS[[*range(9, 14), 32]] = 0
CLASS[[*range(48, 58), *range(97, 123)]] = 3
CLASS[65:91] = 2
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
SIGNS = (np.arange(256, dtype=np.uint64) + U(1)) * MIX
np.seterr(over="ignore")


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i for i below n, by doubling."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        width = min(done, n - done)
        out[done : done + width] = out[:width] * U(pow(base, done, 1 << 64))
        done += width
    return out


class Grams:
    """Hashes of the n-grams of texts. Powers of the base are kept between calls."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self._up = self._down = np.ones(1, np.uint64)

    def _tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = 1 << (n - 1).bit_length()
            self._up, self._down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        return self._up, self._down

    def features(self, raw: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the bytes of texts, one after the other with a blank behind each:
        (text, feature) of every n-gram. owner: the text of each byte."""
        kind = CLASS[raw]
        edge = np.diff((kind > 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(begin):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        mine = owner[begin]
        each = lambda x: np.add.reduceat(x, begin)
        # A polynomial of the letters, from the first one on: what a word is called.
        up, down = self._tables(len(raw))
        letter = kind > 1
        first = np.minimum.reduceat(np.where(letter, np.arange(len(raw)), len(raw) - 1), begin)
        name = each(np.where(letter, (SMALL[raw] + U(1)) * up[: len(raw)], U(0))) * down[first]
        # Other signs count by what they are, before or behind the letters.
        signs = each(np.where(kind == 1, SIGNS[raw], U(0)))
        letters, capitals = each(letter.astype(np.int64)), each((kind == 2).astype(np.int64))
        case = np.select([letters == 0, capitals == 0, (capitals > 1) & (2 * capitals >= letters), capitals == 1], [4, 0, 2, 1], 3).astype(np.uint64)
        outer = (kind[begin] == 1).astype(np.uint64) + U(2) * (kind[end - 1] == 1)
        shape = signs * MIX + (case * U(4) + outer) * STEP
        name = np.where(letters > 0, name, signs)
        # A word beside the one before it in its text; whether it repeats it, and that one the one before.
        follows = np.flatnonzero(mine[1:] == mine[:-1]) + 1
        same = np.append(False, (name[1:] == name[:-1]) & (mine[1:] == mine[:-1]))
        repeat = same[follows] + U(2) * (same[follows] & same[follows - 1])
        found = [
            (mine, name * STEP + U(1)),
            (mine, shape * MIX + U(2)),
            (mine[follows], (name[follows - 1] * MIX + name[follows]) * STEP + U(3)),
            (mine[follows], (shape[follows - 1] * STEP + shape[follows]) * MIX + U(4)),
            (mine[follows], repeat * STEP + U(5)),
        ]
        h = np.concatenate([x for _, x in found])
        h = (h ^ (h >> U(31))) * MIX
        return np.concatenate([x for x, _ in found]), ((h ^ (h >> U(29))) * STEP >> U(64 - self.bits)).astype(np.int64)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text's bytes cut at blanks into pieces of about PIECE bytes."""
    begin = 0
    while begin < len(raw):
        end = min(len(raw), begin + PIECE)
        if end < len(raw):
            last = max(raw.rfind(b, begin, end) for b in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
            end = last if last > begin else end
        yield raw[begin:end]
        begin = end


def count_features(texts: list[str | None], grams: Grams) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index, features, values) of each text that has any, features ascending.
    Texts are looked at together up to PIECE bytes; a longer one alone, in pieces."""
    held, size = [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode(errors="replace")
        if len(raw) > PIECE:
            counts = np.zeros(1 << grams.bits, np.int64)
            for piece in _pieces(raw):
                _, feature = grams.features(np.frombuffer(piece, np.uint8), np.zeros(len(piece), np.int64))
                counts += np.bincount(feature, minlength=1 << grams.bits)
            at = np.flatnonzero(counts)
            if len(at):
                yield i, at, _scaled(counts[at])
            continue
        if size + len(raw) > PIECE:
            yield from _together(held, grams)
            held, size = [], 0
        held.append((i, raw))
        size += len(raw) + 1
    yield from _together(held, grams)


def _scaled(counts: np.ndarray) -> np.ndarray:
    v = 1 + np.log(counts)
    return v / np.sqrt((v * v).sum())


def _together(held: list[tuple[int, bytes]], grams: Grams) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if not held:
        return
    raw = np.frombuffer(b" ".join([x for _, x in held] + [b""]), np.uint8)
    owner = np.repeat(np.arange(len(held)), [len(x) + 1 for _, x in held])
    text, feature = grams.features(raw, owner)
    key, counts = np.unique(text << grams.bits | feature, return_counts=True)
    limits = np.searchsorted(key, np.arange(len(held) + 1) << grams.bits)
    for (i, _), a, b in zip(held, limits[:-1], limits[1:], strict=True):
        if b > a:
            yield i, key[a:b] & (1 << grams.bits) - 1, _scaled(counts[a:b])


@dataclass
class Leader:
    """State of the update: of each feature, and last of the bias, the sum z that
    the weight follows from and the sum n of squared gradients."""

    z: np.ndarray
    n: np.ndarray

    @staticmethod
    def start(bits: int = BITS) -> Leader:
        return Leader(np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1))

    def weights(self, at=slice(None)) -> np.ndarray:
        """Closed form: 0 within L1, else what minimises the regularised sum."""
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        """One row's step: y is its label, a number from 0 to 1."""
        w = self.weights(at)
        g = (sigmoid(w @ x) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sigmoid(v: float) -> float:
    return float(1 / (1 + np.exp(-v))) if v >= 0 else float(1 - 1 / (1 + np.exp(v)))


def training_row(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(id, h, t, y, text): at most sample labelled training rows. They are chosen
    by hashes of ids and texts alone, so only the texts of those chosen move."""
    y = labels.where(training_row(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y")).where("y is not null")
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    t2 = F.xxhash64("text", F.lit("again"))
    keys = named.select("id", F.xxhash64("text").alias("text"), t2.alias("t2")).distinct().join(y, "id")
    # sampled() orders by hashes of id and "text", here the text's hash; one class, so the labels keep their shares.
    chosen = sampled(keys.select("id", F.lit("all").alias("lang"), F.struct("id", "text", "t2", "y").alias("text")), sample).select("h", "t", F.col("text.id").alias("id"), F.col("text.text").alias("t1"), F.col("text.t2").alias("t2"), F.col("text.y").alias("y"))
    # At most sample rows of numbers. Copies of a row are one example.
    found = named.withColumn("t1", F.xxhash64("text")).withColumn("t2", t2).join(F.broadcast(chosen), ["id", "t1", "t2"])
    return found.groupBy("id", "t1", "t2").agg(F.first("h").alias("h"), F.first("t").alias("t"), F.first("y").alias("y"), F.min("text").alias("text")).select("id", "h", "t", "y", "text")


def _extract(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(bits)
        for b in sliced(batches):
            at, values = [b""] * b.num_rows, [b""] * b.num_rows
            for i, feature, value in count_features(b["text"].to_pylist(), grams):
                at[i], values[i] = feature.astype(np.int32).tobytes(), value.astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([b["h"], b["t"], b["y"], pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["h", "t", "y", "at", "x"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard, in their order, PACK to a row of arrays."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b[c].to_pylist() for c in ("shard", "y", "at", "x")), strict=True):
            if held and (len(held) == PACK or held[0][0] != row[0]):
                yield _pack(held)
                held = []
            held.append(row)
    if held:
        yield _pack(held)


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    sizes = np.array([len(at) // 4 for _, _, at, _ in rows], np.int32)
    packed = [np.array([y for _, y, _, _ in rows]).tobytes(), sizes.tobytes(), b"".join(at for _, _, at, _ in rows), b"".join(x for _, _, _, x in rows)]
    return pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int32()), *[pa.array([x], pa.binary()) for x in packed]], ["shard", "y", "sizes", "at", "x"])


def _round(state: Leader):
    """One pass over each shard's rows from a state; what of the state changed."""

    def moved(shard: int, mine: Leader) -> pa.RecordBatch:
        changed = np.flatnonzero(mine.n != state.n).astype(np.int32)
        parts = [changed.tobytes(), *((new - old)[changed].astype(np.float32).tobytes() for new, old in ((mine.z, state.z), (mine.n, state.n)))]
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *[pa.array([x], pa.binary()) for x in parts]], ["shard", "at", "z", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, shard, mine = len(state.z) - 1, None, None
        for b in sliced(batches, 1):
            if b["shard"][0].as_py() != shard:
                if mine is not None:
                    yield moved(shard, mine)
                shard, mine = b["shard"][0].as_py(), Leader(state.z.copy(), state.n.copy())
            y, sizes, at, x = (np.frombuffer(b[c][0].as_buffer(), t) for c, t in (("y", np.float64), ("sizes", np.int32), ("at", np.int32), ("x", np.float32)))
            ends = np.cumsum(sizes)
            for label, begin, end in zip(y, ends - sizes, ends, strict=True):
                mine.learn(np.append(at[begin:end], np.int32(bias)), np.append(x[begin:end].astype(np.float64), 1.0), float(label))
        if mine is not None:
            yield moved(shard, mine)

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, bits: int = BITS, rounds: int = ROUNDS) -> np.ndarray | None:
    """The weights, the bias last; None without a labelled training row."""
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, sample)
    features = rows.repartition("h", "t").mapInArrow(lean(_extract(bits)), "h long, t long, y double, at binary, x binary").withColumn("shard", F.pmod("t", F.lit(SHARDS)).cast("int"))
    # A shard has sample / SHARDS rows or so: it is dealt once, and each round reads it as it is.
    dealt = features.repartition(SHARDS, "shard").sortWithinPartitions("shard", "h", "t").mapInArrow(lean(_packed), "shard int, y binary, sizes binary, at binary, x binary")
    dealt = materialise(dealt, "quality-shards", SHARDS * FILE_BYTES)
    try:
        state = Leader.start(bits)
        for _ in range(rounds):
            # A row for each shard, of 12 bytes for each feature at most, however many rows were learned from.
            with small_batches(docs.sparkSession, 4):
                moved = dealt.mapInArrow(lean(_round(state)), "shard int, at binary, z binary, n binary").toArrow().sort_by("shard")
            if not moved.num_rows:
                return None
            for i in range(moved.num_rows):
                at, z, n = (np.frombuffer(moved[c][i].as_buffer(), t) for c, t in (("at", np.int32), ("z", np.float32), ("n", np.float32)))
                state.z[at] += z.astype(np.float64) / moved.num_rows
                state.n[at] += n.astype(np.float64) / moved.num_rows
        return state.weights()
    finally:
        drop(dealt)


def _score(weights: np.ndarray | None, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(bits)
        bias = float(weights[-1]) if weights is not None else 0.0
        for b in sliced(batches):
            score = [sigmoid(bias)] * b.num_rows
            if weights is not None:
                for i, at, x in count_features(b["text"].to_pylist(), grams):
                    score[i] = sigmoid(float(weights[at] @ x.astype(np.float32).astype(np.float64)) + bias)
            yield pa.RecordBatch.from_arrays([b["id"], b["held_out"], pa.array(score, pa.float64())], ["id", "held_out", "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """Returns id_col, held_out, score and predicted, a row for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (~training_row(F.col(id_col))).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(lean(_score(weights, bits)), "id long, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
