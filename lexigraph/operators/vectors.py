"""Vector search and vector aggregates.

Searching is a stated set of queries against all rows: each task multiplies its
rows, slice by slice, with blocks of the queries' matrix and keeps its k best for
each query; only those are shuffled. The queries' matrix is sent to the tasks in
blocks of at most ``BLOCK_BYTES``, and a slice has so few rows that its scores
number ``CELLS`` at most. Queries of over ``SENT_BLOCKS`` blocks are dealt into
blocks by hash; one block at a time is read, searched and written, so neither the
driver nor a plan holds more, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotFound
from ..storage import materialise
from .ranking import top_k

BLOCK_BYTES, CELLS, SENT_BLOCKS, EMITTED = 64 << 20, 4 << 20, 8, 1 << 19


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a vector of dim numbers, and the matrix of those."""
    lengths = np.diff(column.offsets.to_numpy())
    usable = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (lengths == dim))
    rows = column.take(pa.array(usable))
    return usable, rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _found(qids: list, score: np.ndarray, ids: np.ndarray, floor: float | None) -> pa.RecordBatch:
    at, which = np.nonzero(score >= floor) if floor is not None else np.nonzero(np.ones_like(score, bool))
    return pa.RecordBatch.from_arrays([pa.array(qids, pa.string()).take(pa.array(at)), pa.array(ids[at, which], pa.int64()), pa.array(score[at, which])], ["qid", "doc", "score"])


def _all(qids: list, q: np.ndarray, floor: float | None):
    """Every score of a slice of EMITTED cells, passed on before the next is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = max(1, EMITTED // len(qids))
        for b in (x.slice(i, few) for x in batches for i in range(0, x.num_rows, few)):
            usable, rows = _matrix(b["vec"], q.shape[1])
            ids = b["id"].to_numpy(zero_copy_only=False)[usable]
            yield _found(qids, q @ rows.T, np.broadcast_to(ids, (len(qids), len(ids))), floor)

    return run


def _best(qids: list, q: np.ndarray, k: int, floor: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = np.empty((len(qids), 0))
        ids = np.empty((len(qids), 0), np.int64)
        few = max(1, CELLS // len(qids))
        for b in (x.slice(i, few) for x in batches for i in range(0, x.num_rows, few)):
            usable, rows = _matrix(b["vec"], q.shape[1])
            score = np.hstack([score, q @ rows.T])
            ids = np.hstack([ids, np.tile(b["id"].to_numpy(zero_copy_only=False)[usable], (len(qids), 1))])
            if score.shape[1] > k:
                shown = np.round(score, 9)
                # Only what is no worse than the k-th best is put in order.
                least = -np.partition(-shown, k - 1, axis=1)[:, k - 1]
                most = int((shown >= least[:, None]).sum(axis=1).max())
                near = np.argpartition(-shown, min(most, shown.shape[1] - 1), axis=1)[:, :most] if most < shown.shape[1] else np.tile(np.arange(shown.shape[1]), (len(shown), 1))
                shown, held = np.take_along_axis(shown, near, 1), np.take_along_axis(ids, near, 1)
                order = np.take_along_axis(near, np.lexsort((held, -shown), axis=1)[:, :k], 1)
                score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        yield _found(qids, score, ids, floor)

    return run


def search(queries: DataFrame, vectors: DataFrame, k: int | None, floor: float | None = None) -> DataFrame:
    """queries (qid, vec), vectors (id, vec) of unit length. Returns (qid, doc,
    score, rank): each query's k nearest by dot product, none below floor. Without a
    cut (k None) all scores come as they are made, (qid, doc, score): a task holds
    those of one slice."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    about = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not about["n"]:
        return queries.sparkSession.createDataFrame([], "qid string, doc long, score double" + ("" if k is None else ", rank int"))
    size = max(1, BLOCK_BYTES // (8 * about["dim"]))
    run = (lambda *a: _all(*a, floor)) if k is None else (lambda *a: _best(*a, k, floor))
    best = lambda part: rows.mapInArrow(run([x for x, _ in part], np.array([v for _, v in part], np.float64)), "qid string, doc long, score double")
    listed = lambda df: sorted((str(r["qid"]), r["vec"]) for r in df.select("qid", "vec").collect())
    if about["n"] <= SENT_BLOCKS * size:
        asked = listed(queries)
        found = [best(asked[i : i + size]) for i in range(0, len(asked), size)]
    else:
        n = -(-2 * about["n"] // size)
        dealt = materialise(queries.select("qid", "vec", F.pmod(F.xxhash64("qid"), F.lit(n)).alias("block")).repartition("block").sortWithinPartitions("block"), "vector-queries")
        found = [materialise(best(part), "vector-hits") for part in (listed(dealt.where(F.col("block") == i)) for i in range(n)) if part]
    found = reduce(DataFrame.unionByName, found)
    return found if k is None else top_k(found, "qid", "score", "doc", k)


def _summed(key: str, batch: pa.RecordBatch) -> pa.RecordBatch:
    """(key, vec) of a batch's keys, null where a key has no number. Shorter vectors
    count for their places."""
    batch = batch.filter(batch["vec"].is_valid())
    lengths = batch["vec"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = batch["vec"].flatten()
    codes = pc.dictionary_encode(batch[key], null_encoding="encode")
    code, n, dim = codes.indices.to_numpy(zero_copy_only=False), len(codes.dictionary), int(lengths.max(initial=0))
    cell = np.repeat(code, lengths) * dim + np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    there = values.is_valid().to_numpy(zero_copy_only=False)
    total = np.bincount(cell[there], weights=values.filter(values.is_valid()).to_numpy(zero_copy_only=False), minlength=n * dim)
    none = np.bincount(cell[there], minlength=n * dim) == 0
    most = np.zeros(n, np.int64)
    np.maximum.at(most, code, lengths)
    used = (np.arange(dim) < most[:, None]).ravel() if n else np.zeros(0, bool)
    sums = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(most)), pa.int32()), pa.array(total[used], pa.float64(), mask=none[used]))
    return pa.RecordBatch.from_arrays([codes.dictionary, sums], [key, "vec"]).filter(pa.array(most > 0))


def mean_vectors(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, vec): the sum of each key's vectors, scaled to unit length. Vectors are
    summed in pieces where they lie; a key's partial sums meet, which are no more
    than the pieces that have it."""
    types = f"`{key}` {dict(rows.dtypes)[key]}, vec array<double>"
    pieces = lambda batches: (x.slice(i, 2048) for x in batches for i in range(0, x.num_rows, 2048))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (_summed(key, b) for b in pieces(batches))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in pieces(batches):
            b = _summed(key, b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0])
            # The last key may go on.
            yield b.slice(0, max(0, b.num_rows - 1))
            held = b.slice(max(0, b.num_rows - 1))
        if held is not None:
            yield held

    sums = rows.select(key, F.col(vec).cast("array<double>").alias("vec")).mapInArrow(partial, types)
    sums = sums.repartition(key).sortWithinPartitions(key).mapInArrow(whole, types)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.coalesce(x * x, F.lit(0.0))))
    return sums.withColumn("norm", norm).select(key, F.transform("vec", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(x)).alias("vec"))


def chunk_vectors(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Passages with their vectors, by space and text."""
    return chunks.join(embeddings, ["space_id", "text_hash"])


def missing_hashes(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Each text that has no vector yet, once."""
    return chunks.select("space_id", "text_hash").distinct().join(embeddings, ["space_id", "text_hash"], "left_anti")


def prune_orphans(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """The vectors that a passage still uses."""
    return embeddings.join(chunks.select("space_id", "text_hash"), ["space_id", "text_hash"], "left_semi")


def has_embedding(embeddings: DataFrame, space: str, text_hash: str) -> bool:
    return not get_embedding(embeddings, space, text_hash).isEmpty()


def get_embedding(embeddings: DataFrame, space: str, text_hash: str) -> DataFrame:
    return embeddings.where((F.col("space_id") == space) & (F.col("text_hash") == text_hash))


def stored_hashes(asked: DataFrame, embeddings: DataFrame) -> DataFrame:
    """asked (space_id, text_hash) with stored: whether each has a vector."""
    have = embeddings.select("space_id", "text_hash", F.lit(True).alias("stored")).distinct()
    return asked.join(have, ["space_id", "text_hash"], "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


def space_usage(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Passages, notes and vectors of each space."""
    used = chunks.groupBy("space_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("note_id").alias("notes"))
    stored = embeddings.groupBy("space_id").agg(F.count(F.lit(1)).alias("embeddings"))
    out = used.join(stored, "space_id", "full_outer")
    return out.select("space_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "notes", "embeddings")])


# ---- spaces ----


def list_spaces(spaces: DataFrame) -> DataFrame:
    return spaces.orderBy("created_at", "id")


def ensure_space(spaces: DataFrame, new: DataFrame) -> DataFrame:
    """spaces with new's rows whose ids it lacks, none of them active."""
    fresh = new.dropDuplicates(["id"]).join(spaces.select("id"), "id", "left_anti")
    return spaces.unionByName(fresh.withColumn("is_active", F.lit(False)).select(*spaces.columns))


def active_space(spaces: DataFrame) -> DataFrame:
    return spaces.where("is_active")


def require_active_space(spaces: DataFrame) -> DataFrame:
    found = active_space(spaces)
    if found.isEmpty():
        raise NotFound("no space is active", hint="index the notes first")
    return found


def space_view(spaces: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Each space with its passages, notes and vectors, 0 where it has none."""
    counts = ("chunks", "notes", "embeddings")
    used = space_usage(chunks, embeddings).withColumnRenamed("space_id", "id")
    return spaces.join(used, "id", "left").select(*spaces.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
