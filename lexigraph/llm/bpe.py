"""Byte-level BPE encoding and decoding of whole texts.

Texts are cut into overlapping chunks that are pre-tokenised in parallel.
Two neighbours resynchronise at the first place in their overlap that both hold
for a pre-token boundary between a letter or digit and a blank:
from such a place on the pre-tokens depend only on what follows, so the pieces
between those places are encoded each on its own, and their ids in order are
the whole text's. Where an overlap never resynchronises (one pre-token longer
than the overlap) the two chunks beside it, and they alone, make one piece: a
pre-token is never cut. Decoding joins the ids' bytes.

Every text takes this way; one of up to CHUNK characters has a single chunk, which
has no neighbour and is a piece as it stands.

Defined results: a null text is an empty one, without ids; repeated rows stay
repeated; no rows give no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, materialise, sliced

CHUNK, OVERLAP = 32_768, 1_024
#: What a pre-token's end may depend on beyond it: two characters of a contraction.
LOOK = 3


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def splitter(pattern: str):
    return regex.compile(pattern)


def encode_piece(enc, pattern: str, text: str) -> np.ndarray:
    """Ids of a text. Where the library's pattern matcher gives up (a run of
    white space beyond its backtracking), the pre-tokens are encoded by themselves."""
    try:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    except BaseException as e:  # its panics are no Exceptions
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        ids = [i for t in splitter(pattern).findall(text) for i in enc._encode_single_piece(t)]
        return np.array(ids, dtype="<u4")


def boundaries(pattern: str, text: str, start: int, last: bool) -> list[int]:
    """Pre-token ends of text, a chunk that begins at start of its document, as
    places in the document: those between an ASCII letter or digit and a blank
    or line end that don't depend on what comes after the chunk."""
    most = len(text) - (1 if last else LOOK)
    ends = (m.end() for m in splitter(pattern).finditer(text))
    return [start + e for e in ends if e <= most and text[e] in " \n" and text[e - 1].isascii() and text[e - 1].isalnum()]


def chunks_of(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk); chunk n is [n * size, (n + 1) * size + overlap)."""
    return [(s, text[s : s + size + overlap]) for s in range(0, max(len(text), 1), size) if s == 0 or s < len(text)]


def _chunk(size: int, overlap: int):
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for row, doc, text in zip(b["row"].to_pylist(), b["doc"].to_pylist(), b["text"].to_pylist(), strict=True):
                cut = chunks_of(text or "", size, overlap)
                rows += [(row, doc, n, len(cut), part) for n, (_, part) in enumerate(cut)]
            yield _arrow(rows, CHUNKS)

    return chunk


CHUNKS = [("row", pa.string()), ("doc", pa.int64()), ("no", pa.int64()), ("n_chunks", pa.int64()), ("part", pa.string())]
SPANS = [*CHUNKS, ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))]


def _arrow(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def _pretokenise(pattern: str, size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for row, doc, no, n, part in zip(*[c.to_pylist() for c in b.columns], strict=True):
                start = no * size
                ends = boundaries(pattern, part, start, no == n - 1)
                rows.append((row, doc, no, n, part, [e for e in ends if no and e < start + overlap], [e for e in ends if no < n - 1 and e >= start + size]))
            yield _arrow(rows, SPANS)

    return run


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in sliced(batches):
            rows = []
            for row, doc, no, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ids = encode_piece(enc, pattern, text or "")
                rows.append((row, doc, no, len(ids), ids.tobytes(), enc.decode_bytes(ids.tolist())))
            yield _arrow(rows, PIECES)

    return run


PIECES = [("row", pa.string()), ("doc", pa.int64()), ("no", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())]
PIECES_SQL = "row string, doc long, no long, n_tokens long, ids binary, decoded binary"


def encode_long(docs: DataFrame, path: str, pattern: str, size: int, overlap: int) -> DataFrame:
    """Of (row, doc, text): the pieces (row, doc, no, n_tokens, ids, decoded) of
    texts. row names a row of docs. What is gathered for a text is its own."""
    chunks = docs.mapInArrow(lean(_chunk(size, overlap)), "row string, doc long, no long, n_chunks long, part string").repartition(F.col("row"), F.col("no"))
    spans = chunks.mapInArrow(lean(_pretokenise(pattern, size, overlap)), "row string, doc long, no long, n_chunks long, part string, left array<long>, right array<long>")
    spans = materialise(spans, "bpe-spans")
    # Only the overlaps' lists travel: the first place that a chunk and its neighbour share, or null.
    ends = spans.select("row", "no", "n_chunks", "left", "right")
    by_no = W.partitionBy("row").orderBy("no")
    both = F.array_intersect("left", F.lag("right").over(by_no))
    start = F.col("no") * size
    begin = F.when(F.col("no") == 0, F.lit(0)).otherwise(F.array_min(both))
    ends = ends.select("row", "no", "n_chunks", begin.alias("begin")).withColumn("end", F.lead("begin").over(by_no))
    ends = ends.withColumn("piece", F.sum(F.col("begin").isNotNull().cast("int")).over(by_no))
    # Of a chunk its piece has what lies between those places, or between the chunks' own starts.
    first = F.coalesce("begin", start)
    after = F.coalesce("end", F.when(F.col("no") == F.col("n_chunks") - 1, F.lit(1 << 62)).otherwise(start + size))
    alone = F.count(F.lit(1)).over(W.partitionBy("row", "piece")) == 1
    ends = ends.select("row", "no", "piece", alone.alias("alone"), (first - start).cast("int").alias("skip"), F.least(after - first, F.lit(size + overlap)).cast("int").alias("length"))
    parts = spans.select("row", "doc", "no", "part").join(ends, ["row", "no"])
    parts = parts.select("row", "doc", "no", "piece", "alone", F.substring("part", F.col("skip") + 1, F.col("length")).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), "")
    several = parts.where("not alone").groupBy("row", "doc", "piece").agg(joined.alias("text"))
    pieces = parts.where("alone").select("row", "doc", "piece", "text").unionByName(several).select("row", "doc", F.col("piece").cast("long").alias("no"), "text")
    return pieces.mapInArrow(lean(_encode(path, pattern)), PIECES_SQL)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Returns id_col, n_tokens, ids_sha256 and decoded_sha256, a row for each
    row of docs. path and pattern name the vocabulary's ranks."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    several = F.coalesce(F.length("text"), F.lit(0)) > size
    # A chunk without a neighbour has nothing to stitch: it is a piece as it stands, in the task that reads it.
    alone = rows.where(~several).select(F.lit("").alias("row"), "doc", F.lit(0).cast("long").alias("no"), "text").mapInArrow(lean(_encode(path, pattern)), PIECES_SQL)
    # Equal rows of several chunks have equal results: they are encoded once and counted.
    long_rows = rows.where(several).groupBy("doc", "text").agg(F.count(F.lit(1)).alias("times"))
    long_rows = materialise(long_rows.withColumn("row", F.concat_ws(":", "doc", F.sha2("text", 256))), "bpe-long")
    pieces = encode_long(long_rows.select("row", "doc", "text"), path, pattern, size, overlap)
    joined = lambda c: F.array_sort(F.collect_list(F.struct("no", c)))
    merged = pieces.groupBy("row", "doc").agg(F.sum("n_tokens").alias("n_tokens"), joined("ids").alias("ids"), joined("decoded").alias("decoded"))
    whole = lambda c: F.aggregate(F.col(c), F.lit(b""), lambda a, x: F.concat(a, x[c]))
    merged = merged.select("row", "doc", "n_tokens", whole("ids").alias("ids"), whole("decoded").alias("decoded"))
    digests = lambda df: df.select(F.col("doc").alias(id_col), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    merged = merged.join(long_rows.select("row", "times"), "row").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return digests(alone).unionByName(digests(merged))


def decode_ids(ids: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded: the bytes of ids_col, little-endian unsigned 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in sliced(batches):
            out = [None if x is None else enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in b[ids_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return ids.mapInArrow(run, ", ".join([*[f"`{n}` {t}" for n, t in ids.dtypes], "decoded binary"]))
