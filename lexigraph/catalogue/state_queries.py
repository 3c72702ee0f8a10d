"""Indexes as tables, state changes, and what else the store does."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import embedding, markdown
from ..functions import text as T
from ..operators import bridge as B
from ..operators import fusion, lexical
from ..operators import links as L
from ..operators import notes as N
from ..operators import revisions as R
from ..operators import terms as M
from ..operators import vectors as V
from ..plans import evaluate, index
from ..storage import materialise
from . import fixtures as X
from .fixtures import bm25_sql, ctes, table
from .registry import query
from .search_queries import FUSE, FUSED, FUSED_META, K, PASSES, _fused
from .term_queries import scored_terms

INDEX = bm25_sql("idx", "notes", "id", {"title": ("title", 3.0), "text": ("body", 1.0)})
BODY_ONLY = bm25_sql("lone", "notes", "id", {"text": ("body", 1.0)})


def _index(spark, sf_dir):
    return lexical.build(X.bodies(spark, sf_dir), "id", {"title": F.col("title"), "text": F.col("body")})


@query(ctes(X.NOTES, X.QUERIES_SQL, X.QUERY_TOKENS, INDEX) + "SELECT field, token, doc, tf, len::INT AS len, df FROM idx_p JOIN idx_d USING (field, token)")
def ret1_postings(spark, sf_dir):
    return _index(spark, sf_dir).postings.select("field", "token", "doc", "tf", "len", "df")


@query(ctes(X.NOTES, X.QUERIES_SQL, X.QUERY_TOKENS, INDEX) + "SELECT field, n, round(avg_len, 6) AS avg_len FROM idx_s")
def ret1_field_statistics(spark, sf_dir):
    return _index(spark, sf_dir).fields.select("field", "n", F.round("avg_len", 6).alias("avg_len"))


@query(ctes(X.NOTES, X.QUERIES_SQL, X.QUERY_TOKENS, BODY_ONLY) + "SELECT qid, doc, rank::INT AS rank FROM lone")
def fil10_zero_boost(spark, sf_dir):
    """A field with boost 0 counts for nothing."""
    return lexical.search(X.golden_queries(spark, sf_dir), _index(spark, sf_dir), {"title": 0.0, "text": 1.0}, K).select("qid", "doc", "rank")


@query(ctes(X.QUERIES_SQL, X.QUERY_TOKENS, FUSED, PASSES, FUSED_META, FUSE) + "SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(text + vector + meta + multi_chunk, 9) DESC, id)::INT AS rank FROM why WHERE text + vector + meta + multi_chunk > 0 QUALIFY rank <= 10")
def ret10_final_order(spark, sf_dir):
    chunks, notes, lex, vec, meta = _fused(spark, sf_dir)
    hits = fusion.fuse(fusion.merge_passes(lex, vec, 0.5, 0.5), chunks, meta, notes, DEFAULTS, (0.5, 0.5))
    return fusion.finish(hits, 10).select("qid", "id", "rank")


@query("SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AS external FROM pages UNION ALL SELECT page_id, false FROM pages")
def fil12_external_targets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.array("url", F.regexp_replace("url", "^[^:]*:", "/"))).alias("t")).select("page_id", T.is_external(F.col("t")).alias("external"))


@query("SELECT event_id, json_extract_string(props, '$.k')::VARCHAR AS k FROM events")
def src10_json_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))




def _linked():
    d = F.col("doc_id")
    return F.concat(F.lit("See [[NT-"), d + 10000, F.lit(" any|"), "lang", F.lit("]], ["), "source", F.lit("](sub/f"), d, F.lit(".md#top), `[[N-1]]` and <http://x.y>."))


@query("SELECT doc_id AS src, 'NT-' || (doc_id + 10000) || ' any' AS target, lang AS anchor, NULL AS heading, 'wikilink' AS kind FROM documents UNION ALL SELECT doc_id, 'sub/f' || doc_id || '.md', source, 'top', 'mdlink' FROM documents")
def txt12_parsed_links(spark, sf_dir):
    return L.extract(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _linked().alias("body")))


@query("SELECT 'NT-' || (doc_id + 10000) AS src, 'NT-' || (doc_id + 10000) AS dst, lang AS anchor, true AS resolved FROM documents UNION ALL SELECT 'NT-' || (doc_id + 10000), 'NT-' || (doc_id + 10000), source, true FROM documents")
def gra9_rebuilt_links(spark, sf_dir):
    """Links of bodies: one by id, one by a path that was adopted."""
    d = F.col("doc_id")
    notes = table(spark, sf_dir, "documents").select(F.concat(F.lit("NT-"), d + 10000).alias("id"), F.concat(F.lit("T"), d).alias("title"), _linked().alias("body"), "doc_id")
    adopted = notes.select(F.col("id").alias("note_id"), F.concat(F.lit("sub/f"), d, F.lit(".md")).alias("source_path"))
    none = spark.createDataFrame([], "note_id string, alias string")
    return L.rebuild(notes, none, adopted).select("src", "dst", "anchor", "resolved")


@query("SELECT doc_id, text || chr(10) || chr(10) || '## Related' || chr(10) || chr(10) || '- [[X-0001 ' || source || ']]' || chr(10) AS body FROM (SELECT doc_id, source, rtrim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents)")
def gra10_related_section(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"), F.lit("X-0001").alias("target"), F.col("source").alias("title"))
    return L.relate(docs).select("doc_id", F.col("new_body").alias("body"))


@query("SELECT doc_id, source AS title, '1. ' || source || chr(10) || '  1.1. Part' AS outline, 2 AS headings FROM documents")
def txt10_outline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", markdown.parsed(F.concat(F.lit("# "), "source", F.lit("\n\n## Part\n\n"), F.col("lang"))).alias("p"))
    return docs.select("doc_id", "p.title", "p.outline", F.size("p.headings").alias("headings"))


@query()
def txt9_markdown_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(markdown.parsed(F.col("text"))["blocks"]).alias("b"))
    return docs.select("doc_id", "b.ord", "b.kind", "b.text")


@query(ctes(X.NOTES, X.CHUNKS) + "SELECT note_id, ord FROM chunks WHERE note_id IN (SELECT id FROM notes WHERE status = 'active')")
def jn9_swept_chunks(spark, sf_dir):
    """Passages of notes that are still searched."""
    kept = X.notes(spark, sf_dir).where("status = 'active'").select(F.col("id").alias("note_id"))
    return X.chunks(spark, sf_dir).join(kept, "note_id", "left_semi").select("note_id", "ord")


@query(ctes(X.CHUNKS) + "SELECT note_id, ord, CASE WHEN lang = 'de' THEN 'new' ELSE text_hash END AS text_hash FROM chunks UNION ALL SELECT -1, 0, 'new'")
def idx3_replaced_chunks(spark, sf_dir):
    rows = X.chunks(spark, sf_dir)
    keys = ["note_id", "ord", "text_hash"]
    fresh = rows.where("lang = 'de'").withColumn("text_hash", F.lit("new")).select(*keys).unionByName(spark.createDataFrame([(-1, 0, "new")], "note_id long, ord long, text_hash string"))
    return N.replace_group(rows.select(*keys), fresh, "note_id")


@query(ctes(X.ALIASES) + "SELECT note_id, alias FROM aliases WHERE alias <> 'the' UNION SELECT doc_id, 'added' FROM documents WHERE lang = 'fr'")
def crd1_alias_changes(spark, sf_dir):
    old = X.aliases(spark, sf_dir)
    new = table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("note_id"), F.lit("added").alias("alias"))
    both = N.upsert(old, new.unionByName(new), ["note_id", "alias"])
    return N.remove(both, old.where("alias = 'the'"), ["note_id", "alias"]).distinct()


@query(ctes(X.REVISIONS) + "SELECT note_id, rev, body FROM revisions WHERE note_id = 3 AND rev = 2")
def rev2_read_revision(spark, sf_dir):
    return R.read_revision(X.revisions(spark, sf_dir), 3, 2).select("note_id", "rev", "body")


@query(ctes(X.REVISIONS) + "SELECT note_id, rev::INT AS rev, body FROM revisions UNION ALL SELECT note_id, (SELECT max(rev) + 1 FROM revisions WHERE note_id = 3)::INT, body FROM revisions WHERE note_id = 3 AND rev = 1")
def rev4_reverted_note(spark, sf_dir):
    log = X.revisions(spark, sf_dir).withColumn("created_at", F.timestamp_millis("created_at"))
    return R.revert(log, 3, 1, "me").select("note_id", "rev", "body")


@query(
    """WITH f AS (SELECT DISTINCT source || '/' || lang AS path, lang FROM documents)
SELECT CASE WHEN lang = 'de' THEN 'skipped' ELSE 'created' END AS action, count(*) AS files FROM f GROUP BY 1"""
)
def agg19_adopt_counts(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang").alias("path"), F.when(F.col("lang") == "de", "Ж").otherwise("ok").alias("body"), F.concat(F.lit("t "), "source", "lang").alias("title")).distinct()
    e = lambda t: spark.createDataFrame([], t)
    return B.adopt_counts(B.adopt_actions(files, e("id string, title string, body string"), e("note_id string, source_path string, body_hash string")))


@query("SELECT doc_id AS path, CASE lang WHEN 'fr' THEN ['a c'] ELSE []::VARCHAR[] END AS losing FROM documents")
def set4_losing_links(spark, sf_dir):
    """Files lack a link that the notes have, in French."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    files = docs.select(d.alias("path"), F.when(F.col("lang") == "fr", "[[B]]").otherwise("[[b]] and [[A c]]").alias("body"))
    notes = docs.select(d.cast("string").alias("id"), F.lit("[[a c|x]] [[B]] [[a c]]").alias("body"))
    actions = docs.select(d.alias("path"), F.lit("updated").alias("action"), d.cast("string").alias("note_id"))
    return B.losing_links(actions, files, notes)


@query(ctes(X.NOTE_TERMS) + "SELECT term, count(*) > 5 AS manual FROM note_terms GROUP BY term UNION ALL SELECT 'zz ' || source, false FROM documents GROUP BY source")
def trm12_upserted_terms(spark, sf_dir):
    """Terms of many notes come again by hand, and new ones automatically."""
    counts = X.note_terms(spark, sf_dir).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    old = counts.select(F.xxhash64("term").alias("id"), "term", F.col("term").alias("lemma"), F.lit("auto").alias("source"), F.lit(False).alias("pinned"), F.lit(False).alias("blocked"), F.lit(1.0).alias("weight"), F.lit(1).alias("df"))
    again = counts.where("n > 5").select("term", F.col("term").alias("lemma"), F.lit("manual").alias("source"), F.lit(1.0).alias("weight"))
    new = table(spark, sf_dir, "documents").select(F.concat(F.lit("zz "), "source").alias("term")).distinct().select("term", F.col("term").alias("lemma"), F.lit("auto").alias("source"), F.lit(0.5).alias("weight"))
    return M.upsert_terms(old, again.unionByName(new)).select("term", (F.col("source") == "manual").alias("manual"))


@query(ctes(X.NOTE_TERMS) + "SELECT note_id, term FROM note_terms WHERE note_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'labelled' FROM labels")
def trm13_replaced_terms(spark, sf_dir):
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("note_id"), F.lit("labelled").alias("term")).distinct()
    return N.replace_group(X.note_terms(spark, sf_dir).select("note_id", "term"), new, "note_id")


@query(ctes(X.NOTE_TERMS) + "SELECT term, term = 'the' AS blocked, CASE WHEN term = 'the' THEN 0.1 ELSE 1.0 END::DOUBLE AS weight FROM (SELECT DISTINCT term FROM note_terms)")
def trm14_flags(spark, sf_dir):
    terms = X.note_terms(spark, sf_dir).select("term").distinct().select("term", F.col("term").alias("lemma"), F.lit(False).alias("pinned"), F.lit(False).alias("blocked"), F.lit(1.0).alias("weight"))
    return M.set_flags(terms, "the", blocked=True, weight=0.1).select("term", "blocked", "weight")


@query(
    """WITH m AS (SELECT doc_id AS note_id, 1.0 / (1 + n_chars) AS score, source FROM documents)
SELECT source AS note_id, count(*) AS n FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY score DESC) AS k FROM m) WHERE k <= 25 GROUP BY source"""
)
def srt9_candidate_pool(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("note_id"), F.col("doc_id").cast("string").alias("lemma"), (1.0 / (1 + F.col("n_chars"))).alias("score"))
    return M.candidate_pool(rows, 12, 6).groupBy("note_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id * 1000 + turn AS id FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 20")
def srt5_recent_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.timestamp_seconds(F.col("conv_id") * 100).alias("created_at"))
    return evaluate.recent_runs(runs).select("id")


@query()
def trm8_embedding_scores(spark, sf_dir):
    """Candidates near their note's mean vector."""
    from .search_queries import _parts

    _, chunks, _, _, model = _parts(spark, sf_dir)
    means = V.mean_vectors(index.embed_here(chunks, model, key="note_id"), "note_id")
    pool = materialise(scored_terms(spark, sf_dir, M.in_pool(12, 6)).select("note_id", "lemma", "text", "score"), "candidate-pool")
    return M.embedding_scores(pool, means, model).select("note_id", "lemma", F.round("embedding", 6).alias("embedding"))


@query(ctes(X.LINKS) + "SELECT src, dst FROM links WHERE NOT (src = 5 AND dst = 38)")
def crd5_deleted_link(spark, sf_dir):
    return L.delete(X.links(spark, sf_dir), 5, 38).select("src", "dst")


@query(ctes(X.CHUNKS) + "SELECT DISTINCT note_id FROM chunks")
def crd3_indexed_notes(spark, sf_dir):
    return X.chunks(spark, sf_dir).select("note_id").distinct()
