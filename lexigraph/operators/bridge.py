"""Import of note files, adoption of foreign folders, and the doctor's checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import markdown
from ..functions import text as T

POLICIES = {"ask": "reported", "db": "kept-database", "file": "took-file", "both": "kept-both"}


def import_actions(files: DataFrame, notes: DataFrame, policy: str = "ask") -> DataFrame:
    """files (filename, id, title, rev, body, has_front) against notes: skip,
    create, unchanged, update, or conflict (the file is behind), with a reason
    or the conflict's resolution."""
    n = notes.select(F.col("id").alias("note"), F.col("title").alias("note_title"), F.col("rev").alias("note_rev"), T.text_hash(F.col("body")).alias("note_hash"))
    f = files.join(n, files["id"] == n["note"], "left")
    same = (T.text_hash(F.col("body")) == F.col("note_hash")) & (F.col("title").isNull() | (F.col("title") == F.col("note_title")))
    reason = F.when(~F.col("has_front"), "no front matter").when(F.col("id").isNull(), "no id").when(T.trim_all(F.col("body")) == "", "empty body")
    action = F.when(reason.isNotNull(), "skip").when(F.col("note").isNull(), "create").when(same, "unchanged").when(F.coalesce("rev", F.lit(0)) < F.col("note_rev"), "conflict").otherwise("update")
    return f.select("filename", "id", action.alias("action"), F.when(action == "conflict", F.lit(POLICIES[policy])).otherwise(reason).alias("detail"))


def conflict_copies(files: DataFrame, notes: DataFrame, actions: DataFrame) -> DataFrame:
    """Under the policy `both`: the notes that the files of conflicts become,
    each linked with the note that stays."""
    mine = actions.where("detail = 'kept-both'").select("filename")
    n = notes.select("id", F.col("title").alias("note_title"))
    f = files.join(mine, "filename", "left_semi").join(n, "id")
    link = F.concat(F.lit("\n\n## Related\n\n- [["), F.col("id"), F.lit(" "), F.col("note_title"), F.lit("]]\n"))
    return f.select("filename", F.concat(F.coalesce("title", F.col("note_title")), F.lit(" (conflict copy)")).alias("title"), F.concat(F.rtrim("body"), link).alias("body"))


def merged_metadata(files: DataFrame, aliases: DataFrame, tags: DataFrame, manual: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """After an import: a file's tags and aliases replace its note's, its manual
    terms are added to the note's. files has id, tags, aliases, keywords_manual,
    phrases_manual; manual has note_id, term, kind."""
    from .notes import clean_tag

    listed = lambda c, name: files.select(F.col("id").alias("note_id"), F.explode(c).alias(name)).withColumn(name, T.trim_all(F.col(name))).where(F.col(name) != "").distinct()
    seen = files.select(F.col("id").alias("note_id")).distinct()
    others = lambda df: df.join(seen, "note_id", "left_anti")
    new_tags = others(tags).unionByName(listed("tags", "tag").withColumn("tag", clean_tag(F.col("tag"))).distinct())
    new_aliases = others(aliases.select("note_id", "alias")).unionByName(listed("aliases", "alias"))
    terms = listed("keywords_manual", "term").withColumn("kind", F.lit("keyword")).unionByName(listed("phrases_manual", "term").withColumn("kind", F.lit("phrase")))
    return new_aliases, new_tags, manual.select("note_id", "term", "kind").unionByName(terms).distinct()


# ---- adoption ----


def basename(path):
    return F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.(md|markdown)$", ""))


def collisions(files: DataFrame) -> DataFrame:
    """(name, paths) of base names that several files have."""
    return files.groupBy(basename(F.col("path")).alias("name")).agg(F.sort_array(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)


def adopt_actions(files: DataFrame, notes: DataFrame, adopted: DataFrame, gate_code: bool = False, import_anyway: bool = False) -> DataFrame:
    """files (path, body, title) of a foreign folder: skipped (another script),
    unchanged, updated, claimed (a note of that title takes the file, once), or
    created; with the note."""
    body = F.col("body") if gate_code else T.strip_code(F.col("body"))
    f = files.select("path", "title", T.blocked_name(body).alias("script"), T.text_hash(F.col("body")).alias("hash"), F.lower(T.trim_all(F.col("title"))).alias("title_key"))
    known = adopted.select(F.col("source_path").alias("path"), F.col("note_id").alias("known_note"), F.col("body_hash").alias("known_hash"))
    f = f.join(known, "path", "left")
    skip = F.col("script").isNotNull() & F.lit(not import_anyway)
    # Of the notes of one title the least may be claimed, if no file has been its source, and by one file.
    free = notes.select(F.lower(T.trim_all(F.col("title"))).alias("title_key"), F.col("id").alias("claim")).where("title_key != ''").groupBy("title_key").agg(F.min("claim").alias("claim"))
    free = free.join(adopted.select(F.col("note_id").alias("claim")), "claim", "left_anti")
    asks = ~skip & F.col("known_note").isNull()
    first = F.row_number().over(W.partitionBy("title_key", asks).orderBy("path")) == 1
    f = f.withColumn("first", asks & first).join(free, "title_key", "left")
    claims = F.col("first") & F.col("claim").isNotNull()
    action = F.when(skip, "skipped").when(F.col("known_hash") == F.col("hash"), "unchanged").when(F.col("known_note").isNotNull(), "updated").when(claims, "claimed").otherwise("created")
    note = F.when(skip, F.lit(None).cast("string")).otherwise(F.coalesce("known_note", F.when(claims, F.col("claim"))))
    return f.select("path", action.alias("action"), note.alias("note_id"), F.when(skip, F.concat(F.lit("not English: "), "script")).alias("reason"))


def losing_links(actions: DataFrame, files: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, losing): links of the note that the file which replaces its body lacks."""
    targets = lambda c: F.transform(markdown.parsed_links(c), lambda l: T.trim_all(l["target"]))
    due = actions.where("action in ('updated', 'claimed')").select("path", "note_id")
    new = files.select("path", targets(F.col("body")).alias("new"))
    old = notes.select(F.col("id").alias("note_id"), targets(F.col("body")).alias("old"))
    low = F.transform("new", F.lower)
    both = due.join(new, "path").join(old, "note_id").withColumn("low", low)
    return both.select("path", F.array_distinct(F.filter("old", lambda t: ~F.array_contains("low", F.lower(t)))).alias("losing"))


def adopt_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("files"))


# ---- doctor ----


def duplicate_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("alias").agg(F.sort_array(F.collect_set("note_id")).alias("notes"), F.count_distinct("note_id").alias("n")).where("n > 1")


def unindexed(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Active English notes without a passage."""
    return notes.where("status = 'active' and lang = 'en'").select("id").join(chunks.select(F.col("note_id").alias("id")), "id", "left_anti")


def chunks_without_vectors(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    return chunks.join(embeddings.select("space_id", "text_hash"), ["space_id", "text_hash"], "left_anti")


def highest_id(notes: DataFrame, prefix: str) -> DataFrame:
    return notes.agg(F.coalesce(F.max(F.when(T.id_prefix(F.col("id")) == prefix, T.id_sequence(F.col("id")))), F.lit(0)).alias("highest"))


def missing_attachments(notes: DataFrame, present: DataFrame) -> DataFrame:
    """(note_id, target): attachments that present (path) doesn't list."""
    wanted = notes.where("status = 'active'").select(F.col("id").alias("note_id"), F.explode(T.attachments(F.col("body"))).alias("target"))
    path = F.coalesce(F.try_url_decode(F.regexp_replace("target", r"\+", "%2B")), "target")
    return wanted.withColumn("path", path).join(present.select("path"), "path", "left_anti").select("note_id", "target")


def doctor(notes: DataFrame, links: DataFrame, aliases: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(check, n): how much each check found, each by aggregates of its own."""
    from .graph import dangling, orphans

    found = {
        "notes": notes,
        "links": links,
        "dangling": dangling(links),
        "orphans": orphans(notes, links),
        "non_english": notes.where("lang != 'en'"),
        "unindexed": unindexed(notes, chunks),
        "chunks_without_vectors": chunks_without_vectors(chunks, embeddings),
        "duplicate_aliases": duplicate_aliases(aliases),
    }
    out = None
    for name, df in found.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def repair(notes: DataFrame, aliases: DataFrame, adopted: DataFrame, links: DataFrame, prefix: str, counter: int) -> tuple[DataFrame, dict]:
    """Mechanical repairs alone: links made anew from the bodies, and the id
    counter raised to the highest id. Returns the links and what changed."""
    from . import links as L

    fresh = L.rebuild(notes, aliases, adopted)
    before, after = (df.where("not resolved").count() for df in (links, fresh))
    highest = highest_id(notes, prefix).first()["highest"]
    return fresh, {"links_resolved": max(0, before - after), "counter": max(counter, highest), "raised": highest > counter}
