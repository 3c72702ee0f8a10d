"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target /
source size. Its whole part is taken; the fractional parts are rounded in
pairs: words' worth of mass moves at random from one document of a pair to the
other until one of the two is integral, which keeps the pair's expected words
exactly. A bucket of a source is folded in one streaming pass with one
fractional document carried along, and the carried ones of ``FAN`` buckets are
combined in the next round of a tree, until one is left for each source, which
is rounded at random. So a source's words miss its target by less than one
document's size.

Random numbers are hashes of (seed, the two documents), so reruns agree, in
whatever partitions and order.

Defined results: a null text has no words; sources order by code point, null
last; a source without words has target 0; a null or repeated id is a document
like any other. A very long text counts by its words, read once; rows of one id
and size may change places; no rows give no rows. Other columns of the input
are kept when asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, estimated_bytes, materialise

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL, CAP = 1.5, 2.0
BUCKETS, FAN = 1024, 32
FOLD = "id long, source string, size long, source_size long, target double, order long, bucket int, whole int, part double, open boolean"
_NAMES = [x.split()[0] for x in FOLD.split(", ")]
KEY, SIZE, ORDER, WHOLE, PART, OPEN = slice(1, 7, 5), *map(_NAMES.index, ("size", "order", "whole", "part", "open"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """Of (source, source_size): adds target. The sources that meet their cap
    are those with the least cap / weight: with sources in that order, the share
    of the open ones is (total - caps before) / (weights from here on), and a
    source is capped while that share of it is above its cap. One window over
    the table of sources, whose rows are no more than there are sources.
    """
    all_w = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(all_w) - 1) % len(weights)) + 1)
    t = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("w"))
    by = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    everything = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("level", (F.sum("source_size").over(everything) * total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    t = t.withColumn("capped", F.col("level") >= F.col("ratio")).withColumn("open_level", F.min(F.when(~F.col("capped"), F.struct("ratio", "source", "level"))).over(everything)["level"])
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.col("w") * F.col("open_level")).alias("target"))


def _u(seed: int, a: int, b: int) -> float:
    return (xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True), seed) + 0.5) / 2.0**64


def pair(seed: int, one: tuple[int, int, float], two: tuple[int, int, float]) -> tuple[float, float]:
    """Each (order, size, fraction in (0, 1)); returns both fractions, one of
    them 0 or 1, their words together and each one's expectation unchanged."""
    (a, p, x), (b, q, y) = one, two
    up = min((1 - x) * p, y * q)  # words that can move from two to one
    down = min(x * p, (1 - y) * q)
    if _u(seed, a, b) * (up + down) < down:
        return (1.0, y - up / q) if (1 - x) * p <= y * q else (x + up / p, 0.0)
    return (0.0, y + down / q) if x * p <= (1 - y) * q else (x - down / p, 1.0)


def _integral(x: float) -> bool:
    return not 1e-12 < x < 1 - 1e-12


def _close(row: list) -> list:
    row[WHOLE], row[PART], row[OPEN] = row[WHOLE] + round(row[PART]), 0.0, False
    return row


def _fold(seed: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = None, None
        for batch in batches:
            schema, out = batch.schema, []
            for row in map(list, zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                if held is not None and held[KEY] != row[KEY]:
                    out.append(held)
                    held = None
                if not row[OPEN]:
                    out.append(row)
                    continue
                if held is None:
                    held = row
                    continue
                held[PART], row[PART] = pair(seed, (held[ORDER], held[SIZE], held[PART]), (row[ORDER], row[SIZE], row[PART]))
                if _integral(row[PART]):
                    held, row = row, held
                out.append(_close(held))
                held = row
                if _integral(held[PART]):
                    out.append(_close(held))
                    held = None
            yield _batch(out, schema)
        if held is not None:
            yield _batch([held], schema)

    return fold


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 8, buckets: int = BUCKETS, fan: int = FAN) -> DataFrame:
    """Returns id_col, size, source_size, target, taken, copies."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    rows = materialise(rows, "mix-sizes")
    about = 8 * estimated_bytes(rows)  # of a level's table, which has more columns
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    t = targets.withColumnRenamed("source", "t_source")
    rows = rows.join(t, rows["source"].eqNullSafe(t["t_source"])).drop("t_source")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    order = F.xxhash64("id", "size", F.lit(seed))
    level = rows.withColumn("order", order).withColumn("bucket", F.pmod(order, F.lit(buckets)).cast("int")).withColumn("whole", F.floor(copies).cast("int"))
    level = level.withColumn("part", copies - F.col("whole")).withColumn("open", (F.col("size") > 0) & (F.col("part") > 1e-12))
    level = level.select(*_NAMES)
    done, n = [], buckets
    while True:
        folded = materialise(level.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "order").mapInArrow(_fold(seed), FOLD), "mix-level", about)
        done.append(folded.where("not open"))
        level = folded.where("open")
        if n == 1:
            break
        n = -(-n // fan)
        level = level.withColumn("bucket", F.pmod("bucket", F.lit(n)).cast("int"))
    last = level.withColumn("whole", F.col("whole") + ((F.pmod(F.xxhash64("order", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)) < F.col("part")).cast("int"))
    out = last
    for d in done:
        out = out.unionByName(d)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("whole") * F.col("size")).cast("long").alias("taken"), F.col("whole").alias("copies"))
