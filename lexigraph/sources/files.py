"""Folders of markdown files with YAML front matter, and golden query sets.

Files are read and written through Spark's and Hadoop's file systems, so any
store that Spark reaches will do.
"""

from __future__ import annotations

import re

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..functions import text as T

#: Folders that hold no notes.
IGNORED = (".git", "node_modules", ".obsidian", ".trash")
MARK = "---"
NOTICE = "# generated; edits below this line are not read back"
FRONT = "struct<id:string,title:string,status:string,rev:int,body_hash:string,tags:array<string>,aliases:array<string>,keywords_manual:array<string>,phrases_manual:array<string>>"
FILE = f"struct<front:{FRONT},body:string,error:string>"


def find_markdown(spark: SparkSession, root: str, ignore: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, body) of each markdown file below root, path relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = root.rstrip("/").split("://")[-1].rstrip("/")
    relative = F.element_at(F.split(F.col("path"), "\\Q" + tail + "/\\E", 2), -1)
    out = files.select(relative.alias("path"), F.decode("content", "UTF-8").alias("body"))
    skip = "|".join(re.escape(x) for x in ignore)
    return out.where(F.col("path").rlike(r"(?i)\.(md|markdown)$") & ~F.col("path").rlike(rf"(^|/)({skip})/"))


def under(files: DataFrame, only: list[str] = (), ours: list[str] = ()) -> DataFrame:
    """The files at or below one of only (all if there is none), but those below ours."""
    path = T.source_path(F.col("path"))
    within = lambda p: (path == p) | path.startswith(p.rstrip("/") + "/")
    keep = F.lit(not only)
    for p in only:
        keep |= within(p)
    for p in ours:
        keep &= ~within(p)
    return files.where(keep)


def _strings(value) -> list[str]:
    if isinstance(value, list):
        return [v.strip() for v in value if isinstance(v, str)]
    return [value.strip()] if isinstance(value, str) and value.strip() else []


def parse_file(source: str) -> dict:
    """front (None without front matter) and body; of the front matter only the
    keys that a note has."""
    source = source.removeprefix("﻿")
    bare = {"front": None, "body": source.strip(), "error": None}
    if not re.match(r"---\r?\n", source):
        return bare
    end = source.find("\n" + MARK, len(MARK))
    if end < 0:
        return bare
    try:
        found = yaml.safe_load(source[len(MARK) + 1 : end])
    except yaml.YAMLError as e:
        return bare | {"error": f"the front matter is not YAML: {type(e).__name__}"}
    body = re.sub(r"^\r?\n", "", source[end + len(MARK) + 1 :]).strip()
    if not isinstance(found, dict):
        return bare | {"body": body}
    text = lambda k: found[k] if isinstance(found.get(k), str) else None
    rev = found.get("rev")
    front = {"id": text("id"), "title": text("title"), "status": found.get("status") if found.get("status") in ("active", "draft", "archived") else None, "rev": rev if isinstance(rev, int) and not isinstance(rev, bool) else None, "body_hash": text("body_hash")}
    return {"front": front | {k: _strings(found.get(k)) for k in ("tags", "aliases", "keywords_manual", "phrases_manual")}, "body": body, "error": None}


def parsed_file(source: Column) -> Column:
    @F.pandas_udf(FILE)
    def run(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_file(r or "") for r in rows], columns=["front", "body", "error"])

    return run(source)


def render(note: dict) -> str:
    """A note as a file: what is read back, then what was generated, then the body."""
    dump = lambda x: yaml.safe_dump(x, sort_keys=False, allow_unicode=True, default_flow_style=False, width=10_000).rstrip()
    kept = {k: note[k] for k in ("id", "title", "status", "rev", "created", "updated", "body_hash") if k in note}
    kept |= {k: list(note[k]) for k in ("tags", "aliases", "keywords_manual", "phrases_manual") if note.get(k) is not None and len(note[k])}
    made = {k: list(note[k]) for k in ("keywords_auto", "phrases_auto", "links", "backlinks") if note.get(k) is not None and len(note[k])}
    if note.get("outline"):
        made["outline"] = note["outline"]
    below = ["", NOTICE, dump(made)] if made else []
    return "\n".join([MARK, dump(kept), *below, MARK, "", (note["body"] or "").rstrip(), ""])


def rendered(notes: DataFrame) -> DataFrame:
    """(filename, contents) of each note with its attributes."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "title": pdf["title"], "contents": [render(r) for r in pdf.to_dict("records")]})

    out = notes.mapInPandas(run, "id string, title string, contents string")
    return out.select(T.export_filename(F.col("id"), F.col("title")).alias("filename"), "id", "contents")


def export_actions(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """wanted (filename, id, contents) against present (filename, contents):
    created, updated, unchanged, and removed, which only files that carry one
    of our ids are."""
    have = present.select("filename", F.col("contents").alias("old"))
    both = wanted.join(have, "filename", "full_outer")
    new, old = F.col("contents"), F.col("old")
    action = F.when(old.isNull(), "created").when(new.isNull() & T.id_of_filename(F.col("filename")).isNotNull(), "removed").when(new.isNull(), "foreign").when(new == old, "unchanged").otherwise("updated")
    return both.select("filename", "id", "contents", action.alias("action")).where("action != 'foreign'")


def apply_export(spark: SparkSession, actions: DataFrame, folder: str) -> dict[str, int]:
    """Writes and removes files row by row through the driver, which holds one
    file's text at a time: the folder is one person's notes, not a corpus."""
    rows = actions.where("action in ('created', 'updated')").select("filename", "contents")
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in rows.toLocalIterator():  # a file each: a sink to one folder, row by row in bounded memory
        out = fs.create(fs_path(folder, r["filename"]), True)
        out.write(bytearray(r["contents"].encode()))
        out.close()
    for r in actions.where("action = 'removed'").select("filename").toLocalIterator():
        fs.delete(fs_path(folder, r["filename"]), False)
    return {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}


def read_golden(spark: SparkSession, source: str) -> DataFrame:
    """A golden set's YAML text as (qid, q, relevant, irrelevant)."""
    try:
        found = yaml.safe_load(source)
    except yaml.YAMLError as e:
        raise BadRequest("the query set is not YAML", {"cause": str(e)}) from e
    found = found.get("queries") if isinstance(found, dict) else found
    if not isinstance(found, list) or not found:
        raise BadRequest("a query set is a list of queries")
    rows = []
    for i, one in enumerate(found):
        q = one.get("q") if isinstance(one, dict) else None
        if not isinstance(q, str) or not q.strip():
            raise BadRequest(f"query {i + 1} has no q", {"index": i})
        lists = []
        for key in ("relevant", "irrelevant"):
            ids = one.get(key, [])
            ids = [ids] if isinstance(ids, str) else ids
            if not isinstance(ids, list) or not all(isinstance(x, str) for x in ids):
                raise BadRequest(f"{key} of query {i + 1} is no list of ids", {"index": i})
            lists.append([x.strip() for x in ids])
        rows.append((f"q{i + 1:04d}", q.strip(), *lists))
    return spark.createDataFrame(rows, "qid string, q string, relevant array<string>, irrelevant array<string>")
