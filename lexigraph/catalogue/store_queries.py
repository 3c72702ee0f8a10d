"""Passages and vectors, revisions, import and adoption, checks, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bridge as B
from ..operators import notes as N
from ..operators import revisions as R
from ..operators import vectors as V
from ..plans import index
from ..sources import files as files_
from ..sources.warehouse import fingerprint_row
from ..streaming import reindex
from . import fixtures as X
from .fixtures import ctes, table
from .registry import query


@query(ctes(X.CHUNKS) + "SELECT note_id, ord, text_hash FROM chunks JOIN embeddings_of USING (space_id, text_hash)")
def jn1_chunks_with_vectors(spark, sf_dir):
    return V.chunk_vectors(X.chunks(spark, sf_dir), X.embeddings_of(spark, sf_dir)).select("note_id", "ord", "text_hash")


@query(ctes(X.CHUNKS) + "SELECT DISTINCT text_hash FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM embeddings_of e WHERE e.text_hash = c.text_hash)")
def jn8_missing_hashes(spark, sf_dir):
    return V.missing_hashes(X.chunks(spark, sf_dir), X.embeddings_of(spark, sf_dir)).select("text_hash")


@query(ctes(X.CHUNKS) + "SELECT text_hash FROM embeddings_of WHERE text_hash IN (SELECT text_hash FROM chunks)")
def jn7_pruned_vectors(spark, sf_dir):
    return V.prune_orphans(X.embeddings_of(spark, sf_dir), X.chunks(spark, sf_dir)).select("text_hash")


@query(ctes(X.CHUNKS) + "SELECT count(*) AS n FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM embeddings_of e WHERE e.text_hash = c.text_hash)")
def jn6_chunks_without_vectors(spark, sf_dir):
    return B.chunks_without_vectors(X.chunks(spark, sf_dir), X.embeddings_of(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


@query(ctes(X.CHUNKS) + "SELECT c.space_id, c.n AS chunks, c.m AS notes, e.n AS embeddings FROM (SELECT space_id, count(*) AS n, count(DISTINCT note_id) AS m FROM chunks GROUP BY 1) c, (SELECT count(*) AS n FROM embeddings_of) e")
def agg3_space_usage(spark, sf_dir):
    return V.space_usage(X.chunks(spark, sf_dir), X.embeddings_of(spark, sf_dir))


@query(ctes(X.NOTES, X.CHUNKS) + "SELECT id FROM notes WHERE status = 'active' AND lang = 'en' AND id NOT IN (SELECT note_id FROM chunks WHERE length(text) > 400)")
def jn4_unindexed_notes(spark, sf_dir):
    return B.unindexed(X.notes(spark, sf_dir), X.chunks(spark, sf_dir).where(F.length("text") > 400))


@query(
    ctes(X.CHUNKS)
    + """SELECT note_id, CASE WHEN old IS NULL THEN 'new' WHEN fresh IS NULL THEN 'retired' WHEN old = fresh THEN 'current' ELSE 'changed' END AS change
FROM (SELECT note_id, list(ord || text_hash ORDER BY ord) AS old FROM chunks WHERE lang <> 'de' GROUP BY 1)
FULL JOIN (SELECT note_id, list(ord || text_hash ORDER BY ord) AS fresh FROM chunks WHERE length(text) > 20 AND lang <> 'es' GROUP BY 1) USING (note_id)"""
)
def idx2_changed_notes(spark, sf_dir):
    rows = X.chunks(spark, sf_dir).withColumn("strategy", F.lit("fine"))
    return index.changes(rows.where("lang <> 'de'"), rows.where((F.length("text") > 20) & (F.col("lang") != "es")))


@query(
    ctes(X.NOTES, X.CHUNKS, X.ALIASES, X.REVISIONS, X.LINKS)
    + "SELECT (SELECT count(*) FROM notes WHERE status = 'active') AS notes, (SELECT sum(rev)::BIGINT FROM (SELECT 1 AS rev FROM notes WHERE status = 'active')) AS revs, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM embeddings_of) AS embeddings, (SELECT count(*) FROM aliases) AS aliases, (SELECT count(*) FROM notes) AS tags, (SELECT count(*) FROM links) AS links"
)
def src14_fingerprint(spark, sf_dir):
    notes = X.notes(spark, sf_dir)
    dated = notes.withColumn("rev", F.lit(1)).withColumn("updated_at", F.timestamp_seconds("id"))
    row = fingerprint_row(dated, X.chunks(spark, sf_dir), X.embeddings_of(spark, sf_dir), notes, X.aliases(spark, sf_dir), notes, X.links(spark, sf_dir), "s")
    return row.select("notes", F.col("revs").cast("long").alias("revs"), "chunks", "embeddings", "aliases", "tags", "links")


@query("SELECT vec_id, embedding::FLOAT[] AS vec, 256 AS bytes FROM embeddings")
def src11_vector_codec(spark, sf_dir):
    from ..functions import embedding as E

    packed = table(spark, sf_dir, "embeddings").select("vec_id", E.encode_vector(F.col("embedding")).alias("blob"))
    return packed.select("vec_id", E.decode_vector(F.col("blob"), 64).alias("vec"), F.octet_length("blob").alias("bytes"))


# ---- revisions ----


@query(ctes(X.REVISIONS) + "SELECT batch_id, author, count(DISTINCT note_id) AS notes, count(*) AS writes, min(created_at) AS began, max(created_at) AS ended FROM revisions GROUP BY batch_id, author")
def agg7_batches(spark, sf_dir):
    return R.batches(X.revisions(spark, sf_dir))


@query(ctes(X.REVISIONS) + "SELECT batch_id, author, max(created_at) AS ended FROM revisions GROUP BY batch_id, author ORDER BY ended DESC, batch_id, author LIMIT 10")
def srt6_latest_batches(spark, sf_dir):
    return R.batches(X.revisions(spark, sf_dir), 10).select("batch_id", "author", "ended")


@query(ctes(X.REVISIONS) + "SELECT batch_id, note_id, min(rev) AS first_rev FROM revisions GROUP BY ALL")
def agg8_touched_notes(spark, sf_dir):
    return R.touched(X.revisions(spark, sf_dir))


@query(ctes(X.REVISIONS) + "SELECT note_id, rev, lag(rev) OVER (PARTITION BY note_id ORDER BY rev) AS previous_rev FROM revisions")
def win7_previous_revision(spark, sf_dir):
    return R.with_previous(X.revisions(spark, sf_dir)).select("note_id", "rev", "previous_rev")


@query(ctes(X.REVISIONS) + "SELECT a.note_id, a.rev, max(b.rev) AS previous_rev FROM (SELECT note_id, rev * 2 AS rev FROM revisions) a LEFT JOIN revisions b ON b.note_id = a.note_id AND b.rev < a.rev GROUP BY a.note_id, a.rev")
def jn14_revision_before(spark, sf_dir):
    revs = X.revisions(spark, sf_dir)
    return R.revision_before(revs.select("note_id", (F.col("rev") * 2).alias("rev")), revs)


@query(ctes(X.REVISIONS) + "SELECT note_id, rev, title, body FROM revisions QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY rev DESC) = 1")
def rev1_current_notes(spark, sf_dir):
    return N.current(X.revisions(spark, sf_dir)).select("note_id", "rev", "title", "body")


@query(
    ctes(
        X.REVISIONS,
        """
later AS (SELECT note_id, rev, body, CASE WHEN rev = 1 AND author <> 'system' THEN 'create' ELSE 'update' END AS op, author AS batch_id FROM revisions WHERE NOT (rev = 2 AND author = 'user')),
first AS (SELECT batch_id, note_id, min(rev) AS first_rev FROM later GROUP BY ALL)""",
    )
    + """SELECT f.batch_id, f.note_id, f.first_rev, CASE WHEN l.op = 'create' OR f.first_rev < 2 THEN 'archive' WHEN o.rev IS NOT NULL THEN 'restore' ELSE 'missing' END AS action,
  CASE WHEN NOT (l.op = 'create' OR f.first_rev < 2) THEN o.body END AS old_body
FROM first f JOIN later l ON l.note_id = f.note_id AND l.rev = f.first_rev LEFT JOIN later o ON o.note_id = f.note_id AND o.rev = f.first_rev - 1"""
)
def rev5_undo_plan(spark, sf_dir):
    revs = X.revisions(spark, sf_dir).where("not (rev = 2 and author = 'user')").withColumn("op", F.when((F.col("rev") == 1) & (F.col("author") != "system"), "create").otherwise("update")).withColumn("batch_id", F.col("author"))
    return R.undo_plan(revs).select("batch_id", "note_id", "first_rev", "action", "old_body")


@query()
def rev3_revision_diffs(spark, sf_dir):
    return R.diff_revisions(X.revisions(spark, sf_dir))


@query(
    ctes(X.REVISIONS)
    + """, marked AS (SELECT author, note_id, created_at, coalesce(created_at - lag(created_at) OVER w > 600000, true) AS starts FROM revisions WINDOW w AS (PARTITION BY author ORDER BY created_at)),
counted AS (SELECT *, sum(starts::INT) OVER (PARTITION BY author ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS burst FROM marked)
SELECT author, count(*) AS writes, count(DISTINCT note_id) AS notes FROM counted GROUP BY author, burst"""
)
def str3_write_bursts(spark, sf_dir):
    revs = X.revisions(spark, sf_dir).withColumn("created_at", F.timestamp_millis("created_at"))
    return reindex.write_bursts(revs).select("author", "writes", "notes")


# ---- import, adoption, checks ----


@query("SELECT lower(regexp_extract(path, '([^/]*)$', 1)) AS name, list_sort(list(path)) AS paths FROM (SELECT regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^[a-z]+://', '') AS path FROM pages) GROUP BY 1 HAVING count(*) > 1")
def agg20_collisions(spark, sf_dir):
    bare = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return B.collisions(table(spark, sf_dir, "pages").select(F.regexp_replace(bare, "^[a-z]+://", "").alias("path")))


@query(
    """WITH f AS (SELECT doc_id, doc_id::VARCHAR || '.md' AS filename, CASE WHEN source <> 'src3' THEN doc_id END AS id, CASE WHEN lang = 'es' THEN '' WHEN lang = 'fr' THEN text || ' more' ELSE text END AS body, CASE WHEN source = 'src5' THEN 1 ELSE 5 END AS rev, source <> 'src4' AS has_front FROM documents),
n AS (SELECT doc_id AS note, text FROM documents WHERE source <> 'src6')
SELECT filename, id::VARCHAR AS id, CASE WHEN NOT has_front OR id IS NULL OR body = '' THEN 'skip' WHEN note IS NULL THEN 'create' WHEN trim(regexp_replace(body, '[ \\t]+(\\n|$)', '\\1', 'g'), ' ' || chr(9) || chr(10)) = trim(regexp_replace(text, '[ \\t]+(\\n|$)', '\\1', 'g'), ' ' || chr(9) || chr(10)) THEN 'unchanged' WHEN rev < 3 THEN 'conflict' ELSE 'update' END AS action,
  CASE WHEN NOT has_front THEN 'no front matter' WHEN id IS NULL THEN 'no id' WHEN body = '' THEN 'empty body' WHEN note IS NOT NULL AND lang_more AND rev < 3 THEN 'reported' END AS detail
FROM (SELECT *, body LIKE '% more' AS lang_more FROM f) LEFT JOIN n ON note = id"""
)
def imp1_import_actions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    body = F.when(F.col("lang") == "es", "").when(F.col("lang") == "fr", F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    id_ = F.col("doc_id").cast("string")
    files = docs.select(F.concat(id_, F.lit(".md")).alias("filename"), F.when(F.col("source") != "src3", id_).alias("id"), F.lit(None).cast("string").alias("title"), F.when(F.col("source") == "src5", 1).otherwise(5).alias("rev"), body.alias("body"), (F.col("source") != "src4").alias("has_front"))
    notes = docs.where("source <> 'src6'").select(id_.alias("id"), F.lit("t").alias("title"), F.lit(3).alias("rev"), F.col("text").alias("body"))
    return B.import_actions(files, notes)


@query(
    """WITH f AS (SELECT source || '/' || doc_id || '.md' AS path, doc_id, 'Title ' || (doc_id // 3) AS title, lang, source FROM documents),
free AS (SELECT 'Title ' || t AS title, 10000 + t AS claim FROM (SELECT DISTINCT doc_id // 2 AS t FROM documents) WHERE t NOT IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2'))),
a AS (SELECT *, lang = 'de' AS skip, source IN ('src1', 'src2') AS known FROM f),
o AS (SELECT *, NOT skip AND NOT known AND row_number() OVER (PARTITION BY title, NOT skip AND NOT known ORDER BY path) = 1 AS first FROM a)
SELECT path, CASE WHEN skip THEN 'skipped' WHEN source = 'src1' THEN 'unchanged' WHEN source = 'src2' THEN 'updated' WHEN first AND claim IS NOT NULL THEN 'claimed' ELSE 'created' END AS action,
  CASE WHEN skip THEN NULL WHEN known THEN 'N' || (10000 + doc_id) WHEN first AND claim IS NOT NULL THEN 'N' || claim END AS note_id
FROM o LEFT JOIN free USING (title)"""
)
def ado1_adopt_actions(spark, sf_dir):
    """German files get a Cyrillic letter; src1 and src2 came before, src2's changed."""
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    body = F.when(F.col("lang") == "de", F.concat("text", F.lit(" Ж"))).otherwise(F.col("text"))
    path = F.concat("source", F.lit("/"), d, F.lit(".md"))
    files = docs.select(path.alias("path"), body.alias("body"), F.concat(F.lit("Title "), F.floor(d / 3)).alias("title"))
    notes = docs.select(F.floor(d / 2).alias("t")).distinct().select(F.concat(F.lit("N"), F.col("t") + 10000).alias("id"), F.concat(F.lit("title "), "t").alias("title"))
    known = docs.where("source in ('src1', 'src2')")
    old = F.when(F.col("source") == "src1", T.text_hash(body)).otherwise(F.lit("older"))
    adopted = known.select(path.alias("source_path"), F.concat(F.lit("N"), d + 10000).alias("note_id"), old.alias("body_hash"))
    # Notes that src1's and src2's files are the sources of can't be claimed.
    return B.adopt_actions(files, notes, adopted, gate_code=True).select("path", "action", "note_id")


@query(
    ctes(X.NOTES, X.LINKS, X.ALIASES, X.CHUNKS)
    + """SELECT 'notes' AS "check", count(*) AS n FROM notes UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'dangling', count(*) FROM links WHERE NOT resolved
UNION ALL SELECT 'orphans', count(*) FROM notes WHERE status = 'active' AND id NOT IN (SELECT src FROM links WHERE resolved) AND id NOT IN (SELECT dst FROM links WHERE resolved)
UNION ALL SELECT 'non_english', count(*) FROM notes WHERE lang <> 'en'
UNION ALL SELECT 'unindexed', count(*) FROM notes WHERE status = 'active' AND lang = 'en' AND id NOT IN (SELECT note_id FROM chunks)
UNION ALL SELECT 'chunks_without_vectors', count(*) FROM chunks WHERE text_hash NOT IN (SELECT text_hash FROM embeddings_of)
UNION ALL SELECT 'duplicate_aliases', count(*) FROM (SELECT alias FROM aliases GROUP BY alias HAVING count(DISTINCT note_id) > 1)"""
)
def doc1_doctor(spark, sf_dir):
    return B.doctor(X.notes(spark, sf_dir), X.links(spark, sf_dir), X.aliases(spark, sf_dir), X.chunks(spark, sf_dir), X.embeddings_of(spark, sf_dir))


@query("SELECT max(doc_id) + 1 AS highest FROM documents")
def agg23_highest_id(spark, sf_dir):
    return B.highest_id(table(spark, sf_dir, "documents").select(T.note_id("DOC", F.col("doc_id") + 1).alias("id")), "DOC").select(F.col("highest").cast("long").alias("highest"))


@query("SELECT page_id AS note_id, 'img/' || page_id || '.png' AS target FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents)")
def doc1_missing_attachments(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    name = lambda c: F.concat(F.lit("img/"), F.col(c).cast("string"), F.lit(".png"))
    notes = pages.select(F.col("page_id").alias("id"), F.concat(F.lit("see ![x]("), name("page_id"), F.lit(")")).alias("body"), F.lit("active").alias("status"))
    return B.missing_attachments(notes, table(spark, sf_dir, "documents").select(name("doc_id").alias("path")))


@query("""SELECT filename, action FROM (SELECT 'DOC-' || (doc_id + 10000) || ' ' || source || '.md' AS filename, CASE lang WHEN 'en' THEN 'unchanged' WHEN 'fr' THEN 'updated' ELSE 'created' END AS action FROM documents
UNION ALL SELECT 'OLD-' || (page_id + 10000) || ' x.md', 'removed' FROM pages)""")
def src7_export_actions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("DOC-"), F.col("doc_id") + 10000).alias("id"), F.col("source").alias("title"), F.col("text").alias("contents"), "lang")
    wanted = docs.select(T.export_filename(F.col("id"), F.col("title")).alias("filename"), "id", "contents")
    same = docs.where("lang in ('en', 'fr')").select(T.export_filename(F.col("id"), F.col("title")).alias("filename"), F.when(F.col("lang") == "fr", F.concat("contents", F.lit("!"))).otherwise(F.col("contents")).alias("contents"))
    pages = table(spark, sf_dir, "pages")
    old = pages.select(F.concat(F.lit("OLD-"), F.col("page_id") + 10000, F.lit(" x.md")).alias("filename"), F.lit("old").alias("contents"))
    foreign = pages.select(F.concat(F.lit("mine "), F.col("page_id"), F.lit(".md")).alias("filename"), F.lit("own").alias("contents"))
    return files_.export_actions(wanted, same.unionByName(old).unionByName(foreign)).select("filename", "action")


@query("SELECT page_id, 'T ' || page_id AS title, page_id::INT AS rev, ['a', 'b'] AS tags, html AS body FROM (SELECT page_id, trim(html, ' ' || chr(9) || chr(10) || chr(13)) AS html FROM pages)")
def src5_front_matter_round_trip(spark, sf_dir):
    """Each page as a note file with front matter, rendered and read back."""
    pages = table(spark, sf_dir, "pages")
    id_ = F.concat(F.lit("PG-"), F.col("page_id") + 10000)
    notes = pages.select(id_.alias("id"), F.concat(F.lit("T "), "page_id").alias("title"), F.lit("active").alias("status"), F.col("page_id").cast("int").alias("rev"), F.array(F.lit("a"), F.lit("b")).alias("tags"), T.trim_all(F.col("html")).alias("body"))
    back = files_.rendered(notes).select(files_.parsed_file(F.col("contents")).alias("f"))
    return back.select((T.id_sequence(F.col("f.front.id")) - 10000).alias("page_id"), "f.front.title", "f.front.rev", "f.front.tags", "f.body")
