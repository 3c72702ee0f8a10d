"""Searches that score no passages: exact or by pattern, by id, and what of a
note's names a query's words hit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..functions import text as T
from .lexical import strip_stop_words
from .notes import require_note

#: Flags of /pattern/flags and what they are called here.
FLAGS = {"i": "i", "m": "m", "s": "s", "u": "u", "g": "", "y": ""}


def pattern(query: str) -> str:
    """A query as a regular expression: /p/flags is one, all else is literal and
    without regard to case."""
    given = re.fullmatch(r"/(.+)/([gimsuy]*)", query, re.S)
    if not given:
        return r"(?i)" + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", query)
    flags = "".join(sorted({FLAGS[f] for f in given[2]}))
    out = f"(?{flags})" * bool(flags) + given[1]
    try:
        re.compile(out)
    except re.error as e:
        raise BadRequest(f'"{query}" is not a regular expression', {"query": query, "cause": str(e)}, "without the slashes it is searched for as text") from e
    return out


def grep(notes: DataFrame, query: str, n_snippets: int = 2) -> DataFrame:
    """(id, title, score, matches, snippets) of active notes with lines that the
    query fits: 1 + ln(lines), and the first lines with their numbers."""
    sought = F.lit(pattern(query))
    numbered = F.transform(F.split("body", "\n"), lambda line, i: F.struct((i + 1).alias("no"), line.alias("line")))
    found = F.filter(numbered, lambda x: F.rlike(x["line"], sought))
    hits = notes.where("status = 'active'").select("id", "title", found.alias("found")).where(F.size("found") > 0)
    shown = F.transform(F.slice("found", 1, n_snippets), lambda x: F.struct(F.concat(F.lit("line "), x["no"].cast("string")).alias("heading_path"), T.trim_all(x["line"]).alias("text")))
    return hits.select("id", "title", (1 + F.log(F.size("found").cast("double"))).alias("score"), F.size("found").alias("matches"), shown.alias("snippets"))


def by_id(notes: DataFrame, note_id: str) -> DataFrame:
    """A note of any status, with score 1."""
    return require_note(notes, note_id.strip()).select("id", "title", F.lit(1.0).alias("score"))


def explain_words(q: Column) -> Column:
    """The words of a query that reach the lexical pass."""
    words = F.split(strip_stop_words(q), r"\s+")
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z0-9_+#.-]", "")))
    return F.array_distinct(F.filter(bare, lambda w: w != ""))


def matched_fields(queries: DataFrame, fields: DataFrame) -> DataFrame:
    """queries (qid, q, id), fields (id, field, value): the values in which words
    of the query occur, with those words."""
    asked = queries.select("qid", "id", explain_words(F.col("q")).alias("words"))
    rows = asked.join(fields, "id")
    hit = F.filter("words", lambda w: F.contains(F.lower("value"), w))
    return rows.select("qid", "id", "field", "value", hit.alias("words")).where(F.size("words") > 0)


def explain(scored: DataFrame) -> DataFrame:
    """Every matching passage of a note with both halves of its score; scoring
    marks the ones that made the note's."""
    from .fusion import best_per_strategy

    w = W.partitionBy("qid", "note_id").orderBy(F.round("combined", 9).desc(), "chunk_id")
    return best_per_strategy(scored).withColumn("place", F.row_number().over(w))
