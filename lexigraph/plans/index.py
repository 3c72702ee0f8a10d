"""The index pipeline: parse, cut, embed what is new, relink, retire."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import chunking, embedding
from ..operators import links as L
from ..operators import vectors
from ..operators.notes import searchable


@dataclass(frozen=True)
class Indexed:
    chunks: DataFrame
    embeddings: DataFrame
    links: DataFrame
    report: DataFrame  # change, notes
    counters: DataFrame  # name, n


def cut(notes: DataFrame, space: str, settings: dict | None = None, counter: str = "hashing") -> DataFrame:
    """The passages of searchable notes. Ids are hashes of place, so a passage
    keeps its id while its note, strategy and place stay."""
    rows = searchable(notes).select(F.col("id").alias("note_id"), F.explode(chunking.chunks(F.col("body"), settings, counter)).alias("c"))
    return rows.select(
        F.xxhash64(F.lit(space), "note_id", "c.strategy", "c.ord").alias("id"), F.lit(space).alias("space_id"), "note_id", "c.strategy", "c.ord", "c.heading_path", "c.kind", "c.text", "c.text_hash", "c.tokens", "c.embed_text"
    )


def cut_mark(chunks: DataFrame) -> DataFrame:
    """(note_id, mark): what a note's passages are, as one hash."""
    one = F.concat_ws(":", "strategy", F.col("ord").cast("string"), "text_hash")
    return chunks.groupBy("note_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(one)), "\n"), 256).alias("mark"))


def changes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(note_id, change): new, changed, current, or retired."""
    old = cut_mark(stored).withColumnRenamed("mark", "old")
    both = old.join(cut_mark(fresh), "note_id", "full_outer")
    change = F.when(F.col("old").isNull(), "new").when(F.col("mark").isNull(), "retired").when(F.col("old") == F.col("mark"), "current").otherwise("changed")
    return both.select("note_id", change.alias("change"))


def embed_missing(chunks: DataFrame, stored: DataFrame, model: embedding.Model) -> DataFrame:
    """Vectors of the texts that have none: each distinct text once."""
    texts = chunks.groupBy("space_id", "text_hash").agg(F.first("embed_text").alias("embed_text"))
    new = texts.join(stored, ["space_id", "text_hash"], "left_anti")
    return new.select("space_id", "text_hash", embedding.embed(F.col("embed_text"), model).alias("vec"))


def embed_here(chunks: DataFrame, model: embedding.Model, settings: dict | None = None, key: str = "id") -> DataFrame:
    """(key, vec) of passages of which no vectors are stored, made within their rows:
    neither texts nor vectors are moved. Equal texts are embedded each time."""
    return chunks.select(key, embedding.embed(chunking.seen_by_model(F.col("heading_path"), F.col("text"), settings), model).alias("vec"))


def counters(notes: DataFrame, change: DataFrame, fresh: DataFrame, stored: DataFrame, stored_here: DataFrame, kept: DataFrame, links: DataFrame) -> DataFrame:
    """(name, n) of a run: notes seen, cut anew, unchanged, skipped and dropped,
    passages, distinct texts, vectors made, reused and pruned, and links. stored:
    all vectors before, stored_here those of this space, kept all after."""
    keys = ["space_id", "text_hash"]
    texts = fresh.select(*keys).distinct()
    one = F.count(F.lit(1))
    total = notes.agg(one.alias("notes_total"), F.count_if((F.col("status") != "active") | (F.col("lang") != "en")).alias("notes_skipped"))
    moved = change.agg(F.count_if(F.col("change").isin("new", "changed")).alias("notes_chunked"), F.count_if(F.col("change") == "current").alias("notes_unchanged"), F.count_if(F.col("change") == "retired").alias("notes_dropped"))
    parts = [total, moved, fresh.agg(one.alias("chunks")), texts.agg(one.alias("unique_texts"))]
    parts.append(texts.join(stored_here.select(*keys).withColumn("old", F.lit(True)).distinct(), keys, "left").agg(F.count_if(F.col("old").isNull()).alias("embedded"), F.count_if(F.col("old")).alias("reused")))
    parts.append(stored.join(kept.select(*keys), keys, "left_anti").agg(one.alias("pruned_vectors")))
    parts.append(L.sync_totals(links))
    long = [p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in p.columns])).alias("r")).select("r.*") for p in parts]
    return reduce(DataFrame.unionByName, long)


def index(notes: DataFrame, aliases: DataFrame, adopted: DataFrame, stored_chunks: DataFrame, stored_embeddings: DataFrame, model: embedding.Model, settings: dict | None = None) -> Indexed:
    """A whole run: what is stored is only replaced where it changed."""
    settings = settings or DEFAULTS["chunking"]
    space = embedding.space_id(model, settings, chunking.VERSION)
    fresh = cut(notes, space, settings)
    change = changes(stored_chunks.where(F.col("space_id") == space), fresh)
    chunks = fresh.drop("embed_text")
    vectors_now = stored_embeddings.unionByName(embed_missing(fresh, stored_embeddings, model))
    kept = vectors.prune_orphans(vectors_now, chunks.unionByName(stored_chunks.where(F.col("space_id") != space)))
    report = change.groupBy("change").agg(F.count(F.lit(1)).alias("notes"))
    links = L.rebuild(notes, aliases, adopted)
    return Indexed(chunks, kept, links, report, counters(notes, change, fresh, stored_embeddings, stored_embeddings.where(F.col("space_id") == space), kept, links))


def set_active(spaces: DataFrame, space: str) -> DataFrame:
    """Exactly one space is active."""
    return spaces.withColumn("is_active", F.col("id") == space)


def delete_space(spaces: DataFrame, space: str) -> DataFrame:
    """The active space can't be deleted."""
    bad = F.when((F.col("id") == space) & F.col("is_active"), F.raise_error(F.lit("the active space can't be deleted")).cast("boolean")).otherwise(F.col("id") != space)
    return spaces.where(bad)
