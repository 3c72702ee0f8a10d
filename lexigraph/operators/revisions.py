"""The revision log: batches, history, diffs, undo."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import diffing


def batches(revisions: DataFrame, limit: int | None = None) -> DataFrame:
    """(batch_id, author, notes, writes, began, ended), the latest first."""
    out = revisions.where("batch_id is not null").groupBy("batch_id", "author").agg(F.count_distinct("note_id").alias("notes"), F.count(F.lit(1)).alias("writes"), F.min("created_at").alias("began"), F.max("created_at").alias("ended"))
    return out if limit is None else out.orderBy(F.col("ended").desc(), "batch_id", "author").limit(limit)


def touched(revisions: DataFrame) -> DataFrame:
    """(batch_id, note_id, first_rev): each batch's first write to each note."""
    return revisions.where("batch_id is not null").groupBy("batch_id", "note_id").agg(F.min("rev").alias("first_rev"))


def with_previous(revisions: DataFrame) -> DataFrame:
    """Adds the revision before each, null for a note's first."""
    w = W.partitionBy("note_id").orderBy("rev")
    return revisions.withColumn("previous_rev", F.lag("rev").over(w)).withColumn("previous_body", F.lag("body").over(w))


def revision_before(asked: DataFrame, revisions: DataFrame) -> DataFrame:
    """asked (note_id, rev) with the greatest revision below it, null if none:
    asked and stored revisions in one order, each asked one looks back once."""
    wanted = asked.select("note_id", "rev").distinct().select("note_id", "rev", F.lit(0).alias("stored"))
    both = wanted.unionByName(revisions.select("note_id", "rev", F.lit(1).alias("stored")))
    before = W.partitionBy("note_id").orderBy("rev", "stored").rowsBetween(W.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("stored") == 1, F.col("rev")), ignorenulls=True).over(before)
    return both.withColumn("previous_rev", seen).where("stored = 0").select("note_id", "rev", "previous_rev")


def list_revisions(revisions: DataFrame, note_id, limit: int | None = None) -> DataFrame:
    """A note's revisions, the latest first; without their bodies."""
    out = revisions.where(F.col("note_id") == note_id).drop("body").orderBy(F.col("rev").desc())
    return out if limit is None else out.limit(limit)


def get_revision(revisions: DataFrame, note_id, rev: int) -> DataFrame:
    return revisions.where((F.col("note_id") == note_id) & (F.col("rev") == rev))


def read_revision(revisions: DataFrame, note_id, rev: int = 0) -> DataFrame:
    """One revision; 0 is the latest."""
    mine = revisions.where(F.col("note_id") == note_id)
    return mine.where(F.col("rev") == rev) if rev else mine.orderBy(F.col("rev").desc()).limit(1)


def diff_revisions(revisions: DataFrame, context: int = 3) -> DataFrame:
    """Each revision against the one before it (a first one: against nothing)."""
    rows = with_previous(revisions)
    found = diffing.diffs(F.coalesce("previous_body", F.lit("")), F.col("body"), context)
    return rows.select("note_id", "rev", "previous_rev", found.alias("d")).select("note_id", "rev", "previous_rev", "d.added", "d.removed", "d.identical", "d.truncated", F.size("d.hunks").alias("hunks"), "d.unified")


def undo_plan(revisions: DataFrame) -> DataFrame:
    """What undoing each batch does to each note it wrote: restore the revision
    before the batch's first, archive a note that the batch created, or report
    that the earlier revision is missing."""
    first = touched(revisions).withColumn("target_rev", F.col("first_rev") - 1)
    at = revisions.select("note_id", F.col("rev").alias("first_rev"), "op")
    old = revisions.select("note_id", F.col("rev").alias("target_rev"), F.col("body").alias("old_body"), F.lit(True).alias("kept"))
    both = first.join(at, ["note_id", "first_rev"]).join(old, ["note_id", "target_rev"], "left")
    action = F.when(F.col("op").isin("create", "adopt") | (F.col("target_rev") < 1), "archive").when(F.col("kept"), "restore").otherwise("missing")
    return both.select("batch_id", "note_id", "first_rev", "target_rev", action.alias("action"), F.when(action == "restore", F.col("old_body")).alias("old_body"))


def revert(revisions: DataFrame, note_id, to_rev: int, author: str) -> DataFrame:
    """The log with a new revision that has an earlier one's title and body."""
    mine = revisions.where(F.col("note_id") == note_id)
    top = mine.groupBy("note_id").agg(F.max("rev").alias("top"))
    old = mine.where(F.col("rev") == to_rev).join(top, "note_id")
    new = old.select("note_id", (F.col("top") + 1).cast("int").alias("rev"), "title", "body", F.lit("update").alias("op"), F.lit(author).alias("author"), F.lit(None).cast("string").alias("batch_id"), F.current_timestamp().alias("created_at"))
    return revisions.unionByName(new.select(*revisions.columns))


def new_batch_id(now: datetime | None = None) -> str:
    return "b" + (now or datetime.now(timezone.utc)).strftime("%Y%m%d%H%M%S%f")[:-3]
