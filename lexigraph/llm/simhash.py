"""SimHash near-dedup by multi-index hashing.

A fingerprint has a bit for each bit position that over half of the text's
4-word shingles' XXH64 hashes set. Two fingerprints within ``RADIUS`` bits
differ by at most ``RADIUS // SEGMENTS`` bits in one of ``SEGMENTS`` segments:
for each segment the small Hamming ball around a fingerprint's bits is
enumerated, met with the table of all segments, and the complete distance of
what is found is verified within the join. Only distinct fingerprints take part.

A segment's bucket with more than ``DENSE`` fingerprints would make pairs in the
square of its size. Fingerprints that reach such a bucket are linked otherwise,
without loss: two are within 4 bits exactly if their balls of radius 2 share a
point, so each is linked to the least fingerprint at each point of its ball.
That makes 2,081 rows for each, whatever the group's size.

Defined results: words are split at ASCII white space, A-Z are lower-cased, a
text without words has fingerprint zero, a null text too; a null id is in the
component of its fingerprint but never names one. Rows with equal ids share a
component only if their fingerprints do. A bit that exactly half of the hashes have
is 0. A very long text is one row of one task, read whole; no rows give no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import estimated_bytes, lean, materialise, sliced
from .components import components

WORDS, SEED = 4, 42
RADIUS, SEGMENTS, DENSE = 4, 3, 256
BITS = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Python splits bytes at exactly these: \x20 and \x09 to \x0D.
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased text, repeats included."""
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    begins = np.append(0, ends[: n - 1] + 1).tolist()
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(begins, stops, strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit, as an unsigned number."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        fp = np.array([fingerprint(shingle_hashes(t)) for t in b["text"].to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(fp)], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) of every row; fp holds the 64 bits as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(_fingerprints), "id long, fp long")


def _masks(bits: int, radius: int, shift: int = 0) -> list[int]:
    """All patterns of at most radius of the bits, as signed longs."""
    found = [sum(1 << (shift + i) for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in found]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def segments(n: int) -> list[tuple[int, int]]:
    """(shift, bits) of n segments that cover all bits."""
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ", ".join(f"{v}L" if v != -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")")


def _around(segment: int, own: Column, masks: list[int]) -> Column:
    return F.transform(_longs(masks), lambda m: F.struct(F.lit(segment).alias("segment"), own.bitwiseXOR(m).alias("value")))


def links(distinct: DataFrame, radius: int = RADIUS, n_segments: int = SEGMENTS, dense: int = DENSE) -> DataFrame:
    """distinct (fp) without repeats. Returns edges (a, b) of fingerprints whose
    components are those of all pairs within radius bits: the pairs themselves
    but for dense buckets, and there edges to points that such pairs share."""
    ball = radius // n_segments
    tables, probes = [], []
    for i, (shift, bits) in enumerate(segments(n_segments)):
        own = F.col("fp").bitwiseAND(F.lit(_signed(((1 << bits) - 1) << shift)))
        tables.append(F.struct(F.lit(i).alias("segment"), own.alias("value")))
        probes.append(_around(i, own, _masks(bits, ball, shift)))
    table = distinct.select("fp", F.explode(F.array(*tables)).alias("k")).select(F.col("k.segment").alias("segment"), F.col("k.value").alias("value"), F.col("fp").alias("found"))
    probe = distinct.select("fp", F.explode(F.flatten(F.array(*probes))).alias("k")).select("fp", F.col("k.segment").alias("segment"), F.col("k.value").alias("value"))
    full = materialise(table.groupBy("segment", "value").count().where(F.col("count") > dense).select("segment", "value"), "dense")
    if full.isEmpty():
        crowded, sparse = None, table
    else:
        sparse = table.join(full, ["segment", "value"], "left_anti")
        crowded = probe.join(full, ["segment", "value"], "left_semi").select("fp").distinct()
    near = (F.col("found") < F.col("fp")) & (distance(F.col("found"), F.col("fp")) <= radius)
    pairs = probe.join(sparse, ["segment", "value"]).where(near).select(F.col("fp").alias("a"), F.col("found").alias("b"))
    if crowded is None:
        return pairs.distinct()
    points = crowded.repartition("fp").withColumn("point", F.explode(F.transform(_longs(_masks(BITS, radius // 2)), lambda m: F.col("fp").bitwiseXOR(m))))
    stars = _stars(points, radius)
    if radius % 2:  # an odd distance: balls that share no point may still be neighbours
        raise ValueError("dense buckets need an even radius")
    return pairs.unionByName(stars).distinct()


def _stars(points: DataFrame, radius: int) -> DataFrame:
    """(fp, point): edges from each point's fingerprints to its least one, their
    complete distance verified. Only the least and, for each fingerprint, the
    points' least others travel on."""
    least = points.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most").select("point", "b")
    near = (F.col("fp") != F.col("b")) & (distance(F.col("fp"), F.col("b")) <= radius)
    return points.join(least, "point").where(near).groupBy("fp", "b").agg(F.count(F.lit(1)).alias("n")).select(F.col("fp").alias("a"), "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, n_segments: int = SEGMENTS, dense: int = DENSE) -> DataFrame:
    """Returns id_col, fp, fingerprint (16 hex digits) and component_id (the
    least id reachable), a row for each row of docs."""
    marked = materialise(fingerprints(docs, id_col, text_col), "simhash")
    groups = materialise(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-groups")
    found = links(groups.select("fp"), radius, n_segments, dense)
    joined = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")), 16 * estimated_bytes(groups))
    named = groups.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.join(least, "component").select("fp", "component_id")
    return marked.join(names, "fp").select(F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
