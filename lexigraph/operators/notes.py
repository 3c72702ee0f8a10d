"""Scans, lookups and state changes of notes and of what belongs to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import Conflict, NotFound
from ..functions import text as T


def list_notes(notes: DataFrame, status: str | None = "active", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Notes of a status (None: any) in order of id; limit None or -1: all."""
    out = notes if status is None else notes.where(F.col("status") == status)
    out = out.orderBy("id")
    out = out.offset(offset) if offset else out
    return out if limit in (None, -1) else out.limit(limit)


def get_note(notes: DataFrame, note_id: str) -> DataFrame:
    return notes.where(F.col("id") == note_id)


def require_note(notes: DataFrame, note_id: str) -> DataFrame:
    found = get_note(notes, note_id)
    if found.isEmpty():
        raise NotFound(f"no note {note_id}", {"id": note_id})
    return found


def searchable(notes: DataFrame) -> DataFrame:
    return notes.where((F.col("status") == "active") & (F.col("lang") == "en"))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def project_stats(**tables: DataFrame) -> DataFrame:
    """name, n of each table: one aggregate each, brought together by a union."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def grouped_attributes(notes: DataFrame, aliases: DataFrame, tags: DataFrame, note_terms: DataFrame, terms: DataFrame) -> DataFrame:
    """Every note with its aliases, tags, and terms in four lists; a note
    without any has empty lists. Lists are a note's own and are in order."""
    listed = lambda df, c: df.groupBy("note_id").agg(F.sort_array(F.collect_list(c)).alias(f"{c}_list"))
    named = note_terms.select("note_id", "term_id", "kind", "source").join(terms.select(F.col("id").alias("term_id"), "term"), "term_id")
    kinds = [("keyword", "manual"), ("keyword", "auto"), ("phrase", "manual"), ("phrase", "auto")]
    pick = lambda k, s: F.sort_array(F.collect_list(F.when((F.col("kind") == k) & (F.col("source") == s), F.col("term")))).alias(f"{k}s_{s}")
    out = notes
    for df in (listed(aliases, "alias"), listed(tags, "tag"), named.groupBy("note_id").agg(*[pick(k, s) for k, s in kinds])):
        out = out.join(df, out["id"] == df["note_id"], "left").drop("note_id")
    empty = F.array().cast("array<string>")
    lists = ["alias_list", "tag_list", *[f"{k}s_{s}" for k, s in kinds]]
    return out.select(*[c for c in out.columns if c not in lists], *[F.coalesce(c, empty).alias(c) for c in lists])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows, and old's rows whose keys new doesn't have. Of equal keys in
    new one stays."""
    new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def remove(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def replace_group(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the groups that new has are replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def clean_tag(tag: Column) -> Column:
    return T.trim_all(F.regexp_replace(T.trim_all(tag), "^#", ""))


def set_tags(tags: DataFrame, note_tags: DataFrame) -> DataFrame:
    return replace_group(tags, note_tags.withColumn("tag", clean_tag(F.col("tag"))).where("tag != ''").distinct(), "note_id")


def next_ids(existing: DataFrame, new: DataFrame, prefix: str, order: str) -> DataFrame:
    """new with ids after the highest existing one, in order. Numbers come from
    each range's offset, so no task numbers all rows."""
    highest = existing.agg(F.coalesce(F.max(F.when(T.id_prefix(F.col("id")) == prefix, T.id_sequence(F.col("id")))), F.lit(0)).alias("top")).first()["top"]
    from .ranking import row_numbers

    return row_numbers(new, order, "seq").withColumn("id", T.note_id(prefix, F.col("seq") + highest)).drop("seq")


# ---- the revision log ----


def current(revisions: DataFrame) -> DataFrame:
    """The latest revision of each note that isn't deleted."""
    row = F.struct(*[c for c in revisions.columns if c != "note_id"])
    latest = revisions.groupBy("note_id").agg(F.max_by(row, "rev").alias("r"))
    return latest.select("note_id", "r.*").where("op != 'delete'")


def append_revision(revisions: DataFrame, writes: DataFrame) -> DataFrame:
    """writes (note_id, title, body, op, author, batch_id, created_at,
    expected_rev) with their revision numbers. Expecting another revision than
    the latest is a conflict, raised as rows pass."""
    latest = revisions.groupBy("note_id").agg(F.max("rev").alias("last"))
    w = writes.join(latest, "note_id", "left").withColumn("last", F.coalesce("last", F.lit(0)))
    nth = F.row_number().over(W.partitionBy("note_id").orderBy("created_at", "title", "body"))
    stale = F.col("expected_rev").isNotNull() & (F.col("expected_rev") != F.col("last"))
    rev = F.when(stale, F.raise_error(F.concat(F.lit("revision conflict on "), F.col("note_id"))).cast("int")).otherwise((F.col("last") + nth).cast("int"))
    return w.withColumn("rev", rev).select(*revisions.columns)


def check_revision(expected: int | None, actual: int, note_id: str) -> None:
    if expected is not None and expected != actual:
        raise Conflict(f"{note_id} is at revision {actual}, not {expected}", {"id": note_id, "expected": expected, "actual": actual})
