"""Chat formatting: collapse of cumulative snapshots, then rendering.

A logged conversation that is a prefix of a longer one is dropped; of equal
conversations the one with the smallest id stays. DataFrame expressions only.

Prefix hashes are the running XOR of two 64-bit hashes of (position, role,
text), so they combine over blocks: a conversation is cut into blocks of
``BLOCK`` turn numbers, positions and hashes are taken within a block, and the
blocks' offsets are added. No task holds a whole long conversation, and the
rendered text of one comes as a row for each block.

Defined results: rows repeated exactly count once; turns with equal numbers are
ordered by their contents' hashes; null turns come first; a null role renders as
``user`` and a null text as empty, but both differ from the strings in
comparisons; a null conversation id is an id like any other. Turns of one number,
null ones too, are one block of one row. No rows give no rows. Other columns of the
input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4096


def _digest(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *[x for p in parts for x in (p.isNull(), p)])


def turn_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (conv, turn, role, text): the turns with block, pos, length and the
    prefix hashes p1, p2; and for each conversation its turns and full hashes."""
    said = turns.withColumn("d1", _digest(1, F.col("role"), F.col("text"))).withColumn("d2", _digest(2, F.col("role"), F.col("text")))
    said = said.groupBy("conv", "turn", "d1", "d2").agg(F.count(F.lit(1)).alias("copies")).drop("copies")
    said = said.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    order = W.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "d1", "d2")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    said = said.withColumn("local", F.row_number().over(order))
    earlier = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    same = lambda a, b: (a["conv"].eqNullSafe(b["conv"])) & (a["block"] == b["block"])

    blocks = said.groupBy("conv", "block").count().withColumn("offset", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    offsets = blocks.select("conv", "block", "offset")
    placed = said.join(offsets, same(said, offsets)).drop(offsets["conv"]).drop(offsets["block"])
    placed = placed.withColumn("pos", F.col("offset") + F.col("local") - 1)
    placed = placed.withColumn("h1", F.xxhash64("pos", "d1")).withColumn("h2", F.xxhash64("d2", "pos"))
    sums = placed.groupBy("conv", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.count(F.lit(1)).alias("n"))
    start = sums.select("conv", "block", *[F.coalesce(F.bit_xor(b).over(earlier), F.lit(0)).alias(s) for b, s in (("b1", "s1"), ("b2", "s2"))])
    run = placed.withColumn("x1", F.bit_xor("h1").over(upto)).withColumn("x2", F.bit_xor("h2").over(upto))
    run = run.join(start, same(run, start)).drop(start["conv"]).drop(start["block"])
    run = run.select(
        "conv", "turn", "d1", "d2", "block", "pos", (F.col("pos") + 1).alias("length"), F.col("x1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("s2")).alias("p2")
    )
    whole = sums.groupBy("conv").agg(F.sum("n").alias("length"), F.bit_xor("b1").alias("p1"), F.bit_xor("b2").alias("p2"))
    return run, whole


def collapse_snapshots(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns' places, and the maximal conversations (conv, length, copies)."""
    run, whole = turn_prefixes(turns)
    key = ["length", "p1", "p2"]
    # A prefix that more conversations pass than end at is continued by one.
    passed = run.groupBy(*key).agg(F.count(F.lit(1)).alias("passing"))
    ended = whole.groupBy(*key).agg(F.count(F.lit(1)).alias("ending"))
    continued = passed.join(ended, key).where("passing > ending").select(*key)
    ends = whole.groupBy(*key).agg(F.min(F.struct("conv")).alias("first"), F.count(F.lit(1)).alias("copies"))
    kept = ends.join(continued, key, "left_anti").select(F.col("first.conv").alias("conv"), "length", "copies")
    return run, kept


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Returns conv_id, block, n_turns (of the whole conversation), copies and
    rendered: one row for each block of each maximal conversation."""
    turns = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")
    )
    run, kept = collapse_snapshots(turns)
    said = turns.withColumn("d1", _digest(1, F.col("role"), F.col("text"))).withColumn("d2", _digest(2, F.col("role"), F.col("text")))
    kept = kept.withColumnRenamed("conv", "kept_conv")
    said = said.join(kept, said["conv"].eqNullSafe(kept["kept_conv"])).drop("kept_conv")
    said = said.groupBy("conv", "turn", "d1", "d2").agg(F.first(F.struct("role", "text", "length", "copies")).alias("said"))
    said = said.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "d1", "d2", render_turn(F.col("said.role"), F.col("said.text")).alias("part"))))
    return said.groupBy("conv", "block").agg(F.max("said.length").alias("n_turns"), F.max("said.copies").alias("copies"), F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("rendered")).withColumnRenamed(
        "conv", conv_col
    )
