"""Scans, filters and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import notes as N
from . import fixtures as X
from .fixtures import ctes, table
from .registry import query

TOKENS_SQL = "list_filter(list_transform(string_split_regex(lower(text), '[^a-z0-9_+#.-]+'), lambda t: regexp_replace(t, '^[._-]+|[._-]+$', '', 'g')), lambda t: length(t) > 1 AND regexp_matches(t, '[a-z]'))"
SINGULAR_SQL = """CASE WHEN length(w) < 4 OR regexp_matches(w, '(ss|us|is|as|os)$') THEN w
  WHEN regexp_matches(w, '[^aeiou]ies$') THEN w[:-4] || 'y'
  WHEN regexp_matches(w, '(ch|sh|s|x|z)es$') THEN w[:-3]
  WHEN regexp_matches(w, '[^s]s$') THEN w[:-2] ELSE w END"""
SENTENCES_SQL = r"""list_filter(list_transform(string_split(
  regexp_replace(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n{2,}', chr(1), 'g'), '\n([-*#>|])', chr(1) || '\1', 'g'),
  chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"""


@query(ctes(X.NOTES) + "SELECT id, title, lang, tag FROM notes WHERE status = 'active'")
def src1_list_active_notes(spark, sf_dir):
    return N.list_notes(X.notes(spark, sf_dir)).select("id", "title", "lang", "tag")


@query(ctes(X.NOTES) + "SELECT id, title, status FROM notes WHERE id = 17")
def src2_get_note(spark, sf_dir):
    return N.get_note(X.notes(spark, sf_dir), 17).select("id", "title", "status")


@query(ctes(X.NOTES) + "SELECT id FROM notes ORDER BY id LIMIT 20 OFFSET 40")
def srt7_page_of_notes(spark, sf_dir):
    return N.list_notes(X.notes(spark, sf_dir), None, 20, 40).select("id")


@query(ctes(X.NOTES) + "SELECT id FROM notes WHERE status = 'active' AND lang = 'en'")
def fil2_searchable_notes(spark, sf_dir):
    return N.searchable(X.notes(spark, sf_dir)).select("id")


@query(ctes(X.NOTES) + "SELECT status, lang, count(*) AS n FROM notes GROUP BY ALL")
def agg1_notes_by_status(spark, sf_dir):
    return N.counts_by(X.notes(spark, sf_dir), "status", "lang")


@query(
    ctes(X.NOTES, X.LINKS, X.ALIASES, X.CHUNKS)
    + "SELECT 'notes' AS name, count(*) AS n FROM notes UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'aliases', count(*) FROM aliases UNION ALL SELECT 'chunks', count(*) FROM chunks"
)
def agg2_project_stats(spark, sf_dir):
    return N.project_stats(**{k: getattr(X, k)(spark, sf_dir) for k in ("notes", "links", "aliases", "chunks")})


@query(r"SELECT doc_id, sha256(trim(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+(\n|\r|$)', '\1', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS hash FROM documents")
def txt2_text_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.text_hash(F.col("text")).alias("hash"))


@query(f"SELECT doc_id, len(ts)::INT AS n, sha256(array_to_string(ts, ' ')) AS words FROM (SELECT doc_id, {TOKENS_SQL} AS ts FROM documents)")
def txt4_tokenise(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("ts"))
    return docs.select("doc_id", F.size("ts").alias("n"), F.sha2(F.array_join("ts", " "), 256).alias("words"))


@query(f"SELECT w AS word, {SINGULAR_SQL} AS lemma, count(*) AS n FROM (SELECT unnest({TOKENS_SQL}) AS w FROM documents) GROUP BY w")
def txt5_singular(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select("word", T.singular(F.col("word")).alias("lemma"), "n")


@query(f"SELECT doc_id, len(ss)::INT AS n, sha256(array_to_string(ss, '|')) AS sentences FROM (SELECT doc_id, {SENTENCES_SQL} AS ss FROM documents)")
def txt6_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("ss"))
    return docs.select("doc_id", F.size("ss").alias("n"), F.sha2(F.array_join("ss", "|"), 256).alias("sentences"))


MARKED = "'**' || source || '** uses `' || lang || '`' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || 'end'"


def _marked():
    n = F.lit("\n")
    return F.concat(F.lit("**"), "source", F.lit("** uses `"), "lang", F.lit("`"), n, F.lit("```"), n, "text", n, F.lit("```"), n, F.lit("end"))


FENCED_SQL = r"regexp_replace(regexp_replace({}, '(?ms)^```.*?^```', '', 'g'), '(?ms)^~~~.*?^~~~', '', 'g')"


@query(f"SELECT doc_id, regexp_replace({FENCED_SQL.format(MARKED)}, '`[^`\\n]*`', '', 'g') AS bare FROM documents")
def txt7_strip_code(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_code(_marked()).alias("bare"))


@query(
    rf"""WITH b AS (SELECT doc_id, {FENCED_SQL.format(MARKED)} || chr(10) || text AS body FROM documents),
found AS (SELECT doc_id, list_transform(list_concat(regexp_extract_all(body, '\*\*([^*\n]+)\*\*', 1), regexp_extract_all(body, '`([^`\n]+)`', 1)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS found FROM b)
SELECT doc_id, list_filter(found, lambda x: x <> '' AND length(x) < 60) AS emphasised FROM found"""
)
def txt8_emphasised(spark, sf_dir):
    """What stands out in a wrapped text, and in the text as it is."""
    body = F.concat(T.strip_fenced(_marked()), F.lit("\n"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", T.emphasised(body).alias("emphasised"))


@query("""SELECT doc_id, greatest(1, ceil(length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) / 4.0))::INT AS approximate,
  greatest(1, len(regexp_extract_all(lower(text), '[a-z0-9]+')))::INT AS words FROM documents""")
def txt17_token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.approximate_tokens(F.col("text")).alias("approximate"), T.hashing_tokens(F.col("text")).alias("words"))


@query("""SELECT doc_id, 'DOC-' || CASE WHEN doc_id < 9999 THEN lpad((doc_id + 1)::VARCHAR, 4, '0') ELSE (doc_id + 1)::VARCHAR END AS note_id, 'DOC' AS prefix, doc_id + 1 AS seq,
  CASE WHEN length(source) >= 2 THEN NULL END AS bad FROM documents""")
def txt21_note_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", T.note_id("DOC", F.col("doc_id") + 1).alias("note_id"))
    return docs.select("doc_id", "note_id", T.id_prefix(F.col("note_id")).alias("prefix"), T.id_sequence(F.col("note_id")).alias("seq"), T.id_prefix(F.col("source")).alias("bad"))


@query("SELECT page_id, regexp_extract(url, '://([^./]+)', 1) AS name, upper(substr(regexp_extract(url, '://([^./]+)', 1), 1, 3)) AS prefix FROM pages WHERE regexp_matches(url, '://[a-z]{2,}\\.')")
def txt21_derive_prefix(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where(F.col("url").rlike(r"://[a-z]{2,}\.")).select("page_id", F.regexp_extract("url", "://([^./]+)", 1).alias("name"))
    return pages.select("page_id", "name", T.derive_prefix(F.col("name")).alias("prefix"))


@query(
    """SELECT doc_id, CASE lang WHEN 'fr' THEN 'Cyrillic' WHEN 'de' THEN 'Han' END AS script, CASE lang WHEN 'fr' THEN 'Ж' WHEN 'de' THEN '漢' END AS char,
  CASE WHEN lang IN ('fr', 'de') THEN (length(text) - length(replace(text, chr(10), '')) + 2)::INT END AS line,
  CASE WHEN lang IN ('fr', 'de') THEN 5 END AS "column", lang NOT IN ('fr', 'de') AS ok
FROM documents"""
)
def txt22_language_gate(spark, sf_dir):
    """Texts with a Cyrillic or Han character after a line end, by language."""
    docs = table(spark, sf_dir, "documents")
    text = F.concat("text", F.lit("\nabc "), F.when(F.col("lang") == "fr", "Ж漢").when(F.col("lang") == "de", "漢").otherwise("é"))
    return docs.select("doc_id", T.gate(text, gate_code=True).alias("g")).select("doc_id", "g.finding.script", "g.finding.char", "g.finding.line", "g.finding.column", "g.ok")


@query("SELECT doc_id, regexp_matches(low, '(^|[^a-z0-9])the([^a-z0-9]|$)') AS whole, (length(low) - length(replace(low, 'the', ''))) // 3 AS times FROM (SELECT doc_id, lower(text) AS low FROM documents)")
def txt23_words_and_occurrences(spark, sf_dir):
    docs, the = table(spark, sf_dir, "documents"), F.lit("the")
    return docs.select("doc_id", T.whole_word(F.col("text"), the).alias("whole"), T.count_occurrences(F.col("text"), the).cast("long").alias("times"))


@query("SELECT page_id, 'img/' || page_id || '.png' AS first, 'file ' || page_id AS second, 2 AS n FROM pages")
def txt25_attachments(spark, sf_dir):
    p = F.col("page_id").cast("string")
    body = F.concat(F.lit("![a](img/"), p, F.lit(".png) ![b](http://x/y.png) ![[file "), p, F.lit("|alt]] [[note]]"))
    found = table(spark, sf_dir, "pages").select("page_id", T.attachments(body).alias("a"))
    return found.select("page_id", F.get("a", F.lit(0)).alias("first"), F.get("a", F.lit(1)).alias("second"), F.size("a").alias("n"))


@query(r"""WITH t AS (SELECT doc_id, 'DOC-' || lpad((doc_id % 9999 + 1)::VARCHAR, 4, '0') AS id,
  substr(trim(regexp_replace(regexp_replace(text, '[\\/:*?"<>|]', ' ', 'g'), '\s+', ' ', 'g')), 1, 120) AS clean FROM documents)
SELECT doc_id, CASE WHEN clean = '' THEN id || '.md' ELSE id || ' ' || clean || '.md' END AS filename, id AS id_again FROM t""")
def txt26_export_filename(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.export_filename(T.note_id("DOC", F.col("doc_id") % 9999 + 1), F.col("text")).alias("filename"))
    return docs.select("doc_id", "filename", T.id_of_filename(F.col("filename")).alias("id_again"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS ls FROM documents)
SELECT doc_id, substr(trim(regexp_replace(ls[1], '^#+', '')), 1, 120) AS title FROM t""")
def txt27_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.title_or_first_line(F.lit(""), F.col("text")).alias("title"))


@query("""SELECT page_id, tag || '/b/' || page_id AS sibling, 'c/' || page_id AS rooted, page_id::VARCHAR AS file
FROM (SELECT page_id, regexp_extract(url, '://([^./]+)', 1) AS tag FROM pages) WHERE tag <> ''""")
def txt13_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^./]+)", 1).alias("tag")).where("tag <> ''")
    p = F.col("page_id").cast("string")
    start = F.concat("tag", F.lit("/a/x.md"))
    return pages.select(
        "page_id", T.resolve_path(start, F.concat(F.lit("../b/./"), p, F.lit(".md#h"))).alias("sibling"), T.resolve_path(start, F.concat(F.lit("/z/../c/"), p)).alias("rooted"), T.file_reference(F.concat(F.lit("..\\b/"), p, F.lit(".markdown"))).alias("file")
    )


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(list_dot_product(e, list_reverse(e)), 6) AS turned FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def txt20_vector_algebra(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(T.dot(e, e)), 6).alias("norm"), F.round(T.dot(e, F.reverse(e)), 6).alias("turned"))


@query(ctes(X.ALIASES) + "SELECT alias, list_sort(list(note_id)) AS notes FROM aliases GROUP BY alias HAVING count(DISTINCT note_id) > 1")
def agg9_duplicate_aliases(spark, sf_dir):
    from ..operators.bridge import duplicate_aliases

    return duplicate_aliases(X.aliases(spark, sf_dir)).select("alias", "notes")


@query(ctes(X.NOTES, X.ALIASES) + "SELECT n.id, list_sort(list(a.alias)) AS alias_list, [n.tag] AS tag_list FROM notes n JOIN aliases a ON a.note_id = n.id GROUP BY n.id, n.tag")
def agg11_grouped_attributes(spark, sf_dir):
    notes = X.notes(spark, sf_dir)
    none = spark.createDataFrame([], "note_id long, term_id long, kind string, source string")
    terms = spark.createDataFrame([], "id long, term string")
    out = N.grouped_attributes(notes.select("id"), X.aliases(spark, sf_dir), notes.select(F.col("id").alias("note_id"), "tag"), none, terms)
    return out.select("id", "alias_list", "tag_list")


@query("SELECT lower(trim(source)) AS tag, count(*) AS n FROM documents GROUP BY 1")
def crd2_clean_tags(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(F.concat(F.lit(" #"), F.lower("source")).alias("tag"))
    return raw.select(N.clean_tag(F.col("tag")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, to_timestamp(event_id)::TIMESTAMP AS at, strftime(to_timestamp(event_id)::TIMESTAMP, '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM events")
def txt29_iso_timestamps(spark, sf_dir):
    at = F.timestamp_seconds("event_id")
    return table(spark, sf_dir, "events").select("event_id", at.cast("timestamp_ntz").alias("at"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"))
