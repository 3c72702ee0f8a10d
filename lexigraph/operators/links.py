"""Links of notes: extraction, the ladder that resolves targets, rewriting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..functions import markdown
from ..functions import text as T


def extract(notes: DataFrame) -> DataFrame:
    """(src, target, anchor, heading, kind) of each link in each body."""
    return notes.select(F.col("id").alias("src"), F.explode(markdown.parsed_links(F.col("body"))).alias("l")).select("src", "l.*")


def _key(c: Column) -> Column:
    return F.lower(T.trim_all(c))


def _table(df: DataFrame, key: Column, value: str, name: str) -> DataFrame:
    """name_key, name: of rows with one key the least value."""
    return df.select(key.alias(f"{name}_key"), F.col(value).alias("v")).where(F.col(f"{name}_key") != "").groupBy(f"{name}_key").agg(F.min("v").alias(name))


def resolve(links: DataFrame, notes: DataFrame, aliases: DataFrame, adopted: DataFrame) -> DataFrame:
    """links (src, target, ...) with dst and resolved. A target is, in order: an
    id; an alias; a title; a path from where the linking note came from; a path
    from the root; and as a file's name an id, an alias or a title. Archived
    notes are targets too. Each step is an equi-join with a table of its keys.
    """
    ids = notes.select(F.col("id").alias("known_id"))
    titles = _table(notes, _key(F.col("title")), "id", "title")
    names = _table(aliases, _key(F.col("alias")), "note_id", "alias")
    paths = _table(adopted, F.lower(F.regexp_replace(T.source_path(F.col("source_path")), r"(?i)\.(md|markdown)$", "")), "note_id", "path")
    origin = adopted.groupBy(F.col("note_id").alias("src")).agg(F.min("source_path").alias("from_path"))

    df = links.join(origin, "src", "left")
    lead = F.get(F.split(T.trim_all(F.col("target")), r"\s+"), F.lit(0))
    df = df.withColumn("k_id", F.when(T.is_note_id(lead), lead)).withColumn("k_name", _key(F.col("target")))
    df = df.withColumn("k_relative", F.lower(T.resolve_path(F.col("from_path"), F.col("target"))))
    df = df.withColumn("k_root", F.lower(T.resolve_path(F.lit(""), F.col("target"))))
    file = T.file_reference(F.col("target"))
    df = df.withColumn("k_file", F.lower(file)).withColumn("k_file_id", F.get(F.split(file, r"\s+"), F.lit(0)))

    def look(df: DataFrame, table: DataFrame, key: str, value: str, by: str, name: str) -> DataFrame:
        t = table.select(F.col(key).alias(f"__{name}"), F.col(value).alias(name))
        return df.join(t, df[by] == t[f"__{name}"], "left").drop(f"__{name}")

    df = look(df, ids, "known_id", "known_id", "k_id", "r_id")
    df = look(df, names, "alias_key", "alias", "k_name", "r_alias")
    df = look(df, titles, "title_key", "title", "k_name", "r_title")
    df = look(df, paths, "path_key", "path", "k_relative", "r_relative")
    df = look(df, paths, "path_key", "path", "k_root", "r_root")
    df = look(df, ids, "known_id", "known_id", "k_file_id", "r_file_id")
    df = look(df, names, "alias_key", "alias", "k_file", "r_file_alias")
    df = look(df, titles, "title_key", "title", "k_file", "r_file_title")
    file_id = F.when(T.is_note_id(F.col("k_file_id")), F.col("r_file_id"))
    found = F.coalesce("r_alias", "r_title", "r_relative", "r_root", file_id, "r_file_alias", "r_file_title")
    dst = F.when(F.col("k_id").isNotNull(), F.col("k_id")).otherwise(F.coalesce(found, T.trim_all(F.col("target"))))
    resolved = F.when(F.col("k_id").isNotNull(), F.col("r_id").isNotNull()).otherwise(found.isNotNull())
    return df.select(*links.columns, dst.alias("dst"), resolved.alias("resolved"))


def rebuild(notes: DataFrame, aliases: DataFrame, adopted: DataFrame) -> DataFrame:
    """The links table from all bodies: one row for each (src, dst, anchor)."""
    out = resolve(extract(notes), notes, aliases, adopted)
    return out.select("src", "dst", F.coalesce("anchor", F.lit("")).alias("anchor"), "heading", "kind", "resolved").dropDuplicates(["src", "dst", "anchor"])


def sync_totals(links: DataFrame) -> DataFrame:
    return links.agg(F.count(F.lit(1)).alias("links"), F.count_if(~F.col("resolved")).alias("dangling"))


def delete(links: DataFrame, src: str, dst: str, anchor: str | None = None) -> DataFrame:
    gone = (F.col("src") == src) & (F.col("dst") == dst)
    if anchor is not None:
        gone &= F.coalesce("anchor", F.lit("")) == anchor
    return links.where(~gone)


def anchors_of(links: DataFrame) -> DataFrame:
    """(note_id, anchors): what resolved links to each note are called."""
    named = links.where("resolved and anchor is not null and anchor != ''")
    return named.groupBy(F.col("dst").alias("note_id")).agg(F.sort_array(F.collect_list("anchor")).alias("anchors"))


HEADING = re.compile(r"^##\s+Related\s*$", re.I)


def insert_related(body: str, target: str, title: str, anchor: str | None = None) -> str:
    """body with a link in its Related section, which is made if it has none."""
    line = f"- [[{f'{target} {title}'.strip()}{f'|{anchor}' if anchor is not None else ''}]]"
    lines = body.rstrip().split("\n")
    at = next((i for i, x in enumerate(lines) if HEADING.match(x.strip())), None)
    if at is None:
        return "\n".join([*lines, "", "## Related", "", line, ""])
    end = next((i for i in range(at + 1, len(lines)) if re.match(r"^#{1,2}\s", lines[i])), len(lines))
    last = max([at, *(i for i in range(at + 1, end) if lines[i].strip())])
    gap = [""] if last == at else []
    return "\n".join([*lines[: last + 1], *gap, line, *lines[last + 1 :], ""])


def drop_related(body: str, target: str) -> str:
    """body without the links to target in its Related section; an empty section goes."""
    lines = body.rstrip().split("\n")
    at = next((i for i, x in enumerate(lines) if HEADING.match(x.strip())), None)
    if at is None:
        return body
    end = next((i for i in range(at + 1, len(lines)) if re.match(r"^#{1,2}\s", lines[i])), len(lines))
    mine = re.compile(rf"^\s*[-*+]\s+\[\[{re.escape(target)}(?![A-Za-z0-9-])[^\]]*\]\]\s*$")
    kept = [x for x in lines[at + 1 : end] if not mine.match(x)]
    if not any(x.strip() for x in kept):
        return "\n".join([*lines[:at], *lines[end:]]).rstrip() + "\n"
    return "\n".join([*lines[: at + 1], *kept, *lines[end:], ""])


def relate(bodies: DataFrame, add: bool = True, links: DataFrame | None = None) -> DataFrame:
    """(id, body, target, title, and anchor if links are to be named) with new_body:
    the link added or taken out. A note can't be linked with itself. Given the
    links (src, dst) that there are, one that exists can't be added, and one that
    doesn't, or that stands outside the Related section, can't be taken out."""
    names = bodies.columns
    anchor = F.col("anchor") if "anchor" in names else F.lit(None).cast("string")

    @F.pandas_udf("string")
    def edit(body: pd.Series, target: pd.Series, title: pd.Series, anchor: pd.Series) -> pd.Series:
        return pd.Series([insert_related(b, t, n or "", a) if add else drop_related(b, t) for b, t, n, a in zip(body, target, title, anchor, strict=True)])

    out = bodies.withColumn("new_body", edit("body", "target", "title", anchor))
    pair = F.concat("id", F.lit(" and "), "target")
    bad = F.when(F.col("id") == F.col("target"), F.lit("a note can't be linked with itself"))
    if links is not None:
        have = links.select(F.col("src").alias("id"), F.col("dst").alias("target"), F.lit(True).alias("linked")).distinct()
        out = out.join(have, ["id", "target"], "left")
        linked = F.coalesce("linked", F.lit(False))
        if add:
            bad = bad.when(linked, F.concat(F.lit("a link is there already between "), pair))
        else:
            bad = bad.when(~linked, F.concat(F.lit("there is no link between "), pair))
            bad = bad.when(F.col("new_body") == F.col("body"), F.concat(F.lit("written into the text, not its Related section: the link between "), pair))
    return out.select(*names, F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col("new_body")).alias("new_body"))


def require_distinct(src: str, dst: str) -> None:
    if src == dst:
        raise BadRequest("a note can't be linked with itself", {"id": src})
