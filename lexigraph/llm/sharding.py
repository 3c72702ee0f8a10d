"""Sharding by weighted rendezvous hashing of stable record keys.

A record goes to the shard with the largest ``-w / ln(u)``, u being a hash of
(key, shard) in (0, 1). Adding a shard only adds a rival, so records move into
the new shard alone. DataFrame expressions only.

Slots number the rows of a shard without gaps in two levels: rows are dealt to
``slot_buckets`` hash buckets of their shard, by id, size and checksum, numbered
within the bucket, and the bucket's offset (a table of at most shards x
slot_buckets rows) is added. No task holds a shard; rows with one id, a null one
too, are spread unless they are equal in all that is returned.

Defined results: a null key is a key like any other; repeated rows share a
shard and get slots of their own; a null text has size 1 and CRC 0. Equal scores
of two shards go to the lower one; no rows give no rows. Other columns of the input
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOT_BUCKETS = 4096


def unit_hash(*parts: Column) -> Column:
    """A hash of the parts in the open interval (0, 1), 53 bits."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard number, 0 to len(weights) - 1; ties go to the smaller one."""
    scores = [F.struct((F.lit(-float(w)) / F.log(unit_hash(key, F.lit(i)))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return (-F.array_max(F.array(*scores))["shard"]).cast("int")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text", slot_buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Returns id_col, size, text_crc32, law, shard, slot, grown_shard (the shard
    once one of grown_weight is added)."""
    text = F.col(text_col)
    bucket = F.pmod(F.xxhash64("id", "size", "text_crc32", F.lit("slot")), F.lit(slot_buckets)).cast("int")
    placed = lambda df: df.withColumn("shard", rendezvous(F.col("id"), weights)).withColumn("bucket", bucket)
    size, crc = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"), F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    known = placed(docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32")))
    rows = known.withColumn("grown_shard", rendezvous(F.col("id"), [*weights, grown_weight]))
    counts = known.groupBy("shard", "bucket").count()
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("id", "size", "text_crc32"))
    return rows.withColumn("local", local).join(offsets, ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("local") - 1).cast("long").alias("slot"), "grown_shard"
    )
