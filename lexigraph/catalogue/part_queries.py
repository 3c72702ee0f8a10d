"""Parts of search, terms, graph and index that larger plans use, each by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS, apply_patch
from ..functions import text as T
from ..operators import fusion, graph, lexical, metrics, ranking
from ..operators import links as L
from ..operators import notes as N
from ..operators import revisions as R
from ..operators import terms as M
from ..operators import vectors as V
from ..plans import evaluate, index
from ..plans import search as S
from . import fixtures as X
from .fixtures import bm25_sql, ctes, table
from .graph_queries import EDGES, HITS, _edges, _hits
from .registry import fixed, query
from .search_queries import BODY, FUSE, FUSED, FUSED_META, GOLDEN, PASSES, _fused, _hundredths, _passages, _passes, _titles, body_hits, golden
from .term_queries import STATS
from .text_queries import SINGULAR_SQL

WHY = (X.QUERIES_SQL, X.QUERY_TOKENS, FUSED, PASSES, FUSED_META, FUSE)
SUM = "text + vector + meta + multi_chunk"

# ---- search ----


def _hits_of(spark, sf_dir, config=DEFAULTS, mark=None):
    chunks, notes, lex, vec, meta = _fused(spark, sf_dir)
    return fusion.fuse(fusion.merge_passes(lex, vec, 0.5, 0.5), chunks, meta, notes if mark is None else mark(notes), config, (0.5, 0.5))


@query(ctes(*WHY) + f"SELECT qid, id FROM why WHERE {SUM} > 0 AND id % 3 <> 0")
def fil1_active_hits(spark, sf_dir):
    """Notes that aren't active are found and left out."""
    return _hits_of(spark, sf_dir, mark=lambda n: n.withColumn("status", F.when(F.col("id") % 3 == 0, "archived").otherwise("active"))).select("qid", "id")


@query(ctes(*WHY) + "SELECT qid, id, meta AS score FROM why WHERE meta > 0")
def fil4_positive_scores(spark, sf_dir):
    """Passages count for nothing: only what metadata found scores above 0."""
    return _hits_of(spark, sf_dir, apply_patch(DEFAULTS, {"search.fusion.chunk": 0})).select("qid", "id", F.round("score", 6).alias("score"))


@query(ctes(*WHY) + "SELECT qid, note_id AS id FROM by_note UNION SELECT qid, note_id FROM metan")
def set1_union_of_notes(spark, sf_dir):
    return _hits_of(spark, sf_dir).select("qid", "id")


@query(ctes(*WHY) + "SELECT qid, chunk_id, text > 0 AS by_words, vector > 0 AS by_vector FROM merged")
def jn11_either_pass(spark, sf_dir):
    _, lex, vec = _passes(spark, sf_dir)
    return fusion.merge_passes(lex, vec, 0.5, 0.5).select("qid", "chunk_id", (F.col("text") > 0).alias("by_words"), (F.col("vector") > 0).alias("by_vector"))


def _placed(spark, sf_dir):
    chunks, lex, vec = _passes(spark, sf_dir)
    return fusion.merge_passes(lex, vec, 0.5, 0.5).join(chunks.withColumnRenamed("id", "chunk_id").withColumnRenamed("text", "text_of"), "chunk_id")


@query(ctes(*WHY) + "SELECT qid, chunk_id, scoring FROM placed")
def win4_best_of_group(spark, sf_dir):
    return fusion.best_per_strategy(_placed(spark, sf_dir)).select("qid", "chunk_id", "scoring")


@query(ctes(*WHY) + "SELECT DISTINCT qid, note_id, CASE WHEN note_id % 2 = 0 THEN 'H' END AS heading_path FROM placed")
def prj2_empty_as_null(spark, sf_dir):
    rows = _placed(spark, sf_dir).withColumn("heading_path", F.when(F.col("note_id") % 2 == 0, "H").otherwise(""))
    return fusion.snippets(rows, 1).select("qid", "note_id", F.get("snippets", F.lit(0))["heading_path"].alias("heading_path"))


ROWS = "SELECT source AS qid, doc_id AS id, n_chars % 50 / 7.0 AS score FROM documents"


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("qid"), F.col("doc_id").alias("id"), (F.col("n_chars") % 50 / 7.0).alias("score"))


@query(f"SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM ({ROWS}) QUALIFY rank <= 10")
def srt1_final_order(spark, sf_dir):
    return fusion.finish(_rows(spark, sf_dir), 10).select("qid", "id", "rank")


@query(f"SELECT qid, id, round(score, 6) AS score FROM ({ROWS})")
def prj1_rounded_scores(spark, sf_dir):
    return fusion.finish(_rows(spark, sf_dir), 1 << 30).select("qid", "id", "score")


@query(f"SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM ({ROWS}) QUALIFY rank <= 3")
def srt8_best_of_each(spark, sf_dir):
    return ranking.top_k(_rows(spark, sf_dir), "qid", "score", "id", 3).select("qid", "id", "rank")


@query(f"SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS place FROM ({ROWS})")
def win1_distinct_ranks(spark, sf_dir):
    return _rows(spark, sf_dir).select("qid", "id", ranking.rank_of("score", "qid", "id").alias("place"))


@query(ctes(X.NOTE_TERMS) + "SELECT note_id, term, round(tf / max(tf) OVER (PARTITION BY note_id), 6) AS share FROM note_terms")
def win3_share_of_largest(spark, sf_dir):
    return X.note_terms(spark, sf_dir).select("note_id", "term", F.round(ranking.max_normalised("tf", "note_id"), 6).alias("share"))


@query("SELECT a.vec_id::VARCHAR AS qid, v.vec_id AS doc, round(list_dot_product(a.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings v WHERE a.vec_id % 100 = 0")
def jn18_queries_by_vectors(spark, sf_dir):
    """Every stated query against every vector: no cut, no floor."""
    return V.search(*_hundredths(spark, sf_dir), None).select("qid", "doc", F.round("score", 6).alias("score"))


LEX = bm25_sql("lex", "passages", "id", {"text": ("text", 1.0), "heading_path": ("''", 1.5)})
LONE_META = bm25_sql("meta", "titles", "id", {"title": ("title", 3.0)}, require_all=True)
LEXICAL = """
placed AS (
  SELECT l.qid, l.doc AS chunk_id, l.score / max(l.score) OVER (PARTITION BY l.qid) AS text, note_id, strategy FROM lex l JOIN passages p ON p.id = l.doc),
best AS (SELECT *, row_number() OVER (PARTITION BY qid, note_id, strategy ORDER BY round(text, 9) DESC, chunk_id) = 1 AS scoring FROM placed),
by_note AS (SELECT qid, note_id, count(*) AS matched, sum(CASE WHEN scoring THEN (CASE WHEN strategy = 'fine' THEN 1.0 ELSE 0.9 END) * text ELSE 0 END) AS text FROM best GROUP BY qid, note_id),
metan AS (SELECT qid, doc AS note_id, score / max(score) OVER (PARTITION BY qid) AS meta FROM meta),
hits AS (
  SELECT coalesce(b.qid, m.qid) AS qid, coalesce(b.note_id, m.note_id) AS id,
    round(0.7 * coalesce(text, 0.0), 6) + round(0.3 * coalesce(meta, 0.0), 6) + round(0.7 * CASE WHEN coalesce(matched, 0) > 0 THEN 0.15 * ln(1.0 + matched) ELSE 0.0 END, 6) AS score
  FROM by_note b FULL JOIN metan m ON b.qid = m.qid AND b.note_id = m.note_id),
links AS (SELECT id AS src, (id * 7 + 3) % n AS dst, true AS resolved FROM titles, (SELECT count(*) AS n FROM titles)),"""
BOOSTED = """
boosted AS (
  SELECT h.qid, h.id, h.score + coalesce(0.15 * sum(o.score) / any_value(degree), 0) AS score
  FROM hits h LEFT JOIN near ON a = h.id LEFT JOIN hits o ON o.qid = h.qid AND o.id = b LEFT JOIN degree ON node = h.id GROUP BY h.qid, h.id, h.score),
added AS (SELECT h.qid, b AS id, 0.15 * avg(h.score) AS score FROM hits h JOIN near ON a = h.id LEFT JOIN hits o ON o.qid = h.qid AND o.id = b WHERE o.id IS NULL GROUP BY h.qid, b HAVING count(*) >= 2),
everything AS (SELECT * FROM boosted UNION ALL SELECT * FROM added)"""


def _lexical_index(spark, sf_dir):
    chunks, notes = _passages(spark, sf_dir), _titles(spark, sf_dir)
    n = F.lit(notes.count())
    edges = graph.adjacency(notes.select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % n).alias("dst"), F.lit(True).alias("resolved")))
    words = lexical.build(chunks, "id", {"text": F.col("text"), "heading_path": F.col("heading_path")})
    return S.SearchIndex(notes, chunks, spark.createDataFrame([], "id long, vec array<float>"), words, lexical.build(notes, "id", {"title": F.col("title")}), edges, None)


PLAN = ctes(X.QUERIES_SQL, X.QUERY_TOKENS, FUSED, LEX, LONE_META, LEXICAL + EDGES, BOOSTED)


@query(PLAN + "SELECT qid, id, row_number() OVER w::INT AS rank, round(score, 6) AS score FROM everything WINDOW w AS (PARTITION BY qid ORDER BY round(score, 9) DESC, id) QUALIFY rank <= 10")
def ret16_search_lexical(spark, sf_dir):
    """The whole plan without vectors: passages, metadata, fusion, graph, order."""
    asked = X.golden_queries(spark, sf_dir)
    return S.search(_lexical_index(spark, sf_dir), asked, mode="lexical", fuzzy=False).select("qid", "id", "rank", "score")


@query(PLAN + "SELECT qid, id, round(score::DECIMAL(18, 9), 6)::DOUBLE AS score FROM everything")
def gra6_graph_applied(spark, sf_dir):
    idx = _lexical_index(spark, sf_dir)
    asked = X.golden_queries(spark, sf_dir)
    scored = S.retrieve(idx, asked, DEFAULTS, (1.0, 0.0), fuzzy=False)
    meta = lexical.search(asked, idx.note_words, {"title": 3.0}, 150, require_all=True)
    hits = fusion.fuse(scored, idx.chunks, meta, idx.notes, DEFAULTS, (1.0, 0.0))
    return fusion.apply_graph(hits, idx.edges, idx.notes, DEFAULTS).select("qid", "id", F.round(F.col("score").cast("decimal(18,9)"), 6).cast("double").alias("score"))


@query(ctes(X.NOTES, X.QUERIES_SQL, X.QUERY_TOKENS, BODY, GOLDEN) + "SELECT g.qid, CASE WHEN len(g.relevant) > 0 THEN round(count(*) FILTER (WHERE good AND rank <= 3) / len(g.relevant), 6) END AS recall FROM golden g LEFT JOIN judged j USING (qid) GROUP BY g.qid, g.relevant")
def set3_returned_and_relevant(spark, sf_dir):
    rows = metrics.per_query(golden(spark, sf_dir), body_hits(spark, sf_dir).select("qid", F.col("doc").alias("id"), "rank"), 3, 3)
    return rows.select("qid", F.round("recall", 6).alias("recall"))


@query("SELECT item_id::VARCHAR AS qid, row_number() OVER (ORDER BY item_id::VARCHAR) % 2 = 0 AS held_out FROM benchmark")
def evl3_searched_and_held(spark, sf_dir):
    part, held = evaluate.split(X.golden_queries(spark, sf_dir))
    return part.select("qid", F.lit(False).alias("held_out")).unionByName(held.select("qid", F.lit(True).alias("held_out")))


@query(ctes(X.NOTES, X.QUERIES_SQL, X.QUERY_TOKENS, BODY, GOLDEN) + "SELECT 1::BIGINT AS id, count(*)::INT AS queries, round(coalesce(avg(recall), 0), 6) AS recall, round(coalesce(avg(mrr), 0), 6) AS mrr, 5 AS p50_ms, 9 AS p95_ms FROM metrics")
def evl5_logged_run(spark, sf_dir):
    runs = spark.createDataFrame([], "id long, space_id string, queries int, recall_k int, ndcg_k int, recall double, mrr double, ndcg double, p50_ms int, p95_ms int, config string, metrics string, note string, created_at timestamp")
    rows = metrics.per_query(golden(spark, sf_dir), body_hits(spark, sf_dir).select("qid", F.col("doc").alias("id"), "rank"))
    out = evaluate.recent_runs(evaluate.log_run(runs, rows, [3.0, 5.4, 9.2], "{}"))
    return out.select("id", "queries", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "p50_ms", "p95_ms")


@fixed("SELECT * FROM (VALUES ('search.boost.title', 3.0::DOUBLE, 4.5::DOUBLE), ('search.fusion.meta', 0.3, 0.2)) t(path, was, now)")
def evl4_changed_settings(spark, sf_dir):
    found = evaluate.changes(DEFAULTS, {"search.graph.boost": 0.15, "search.fusion.meta": 0.2, "search.boost.title": 4.5})
    return spark.createDataFrame([(c["path"], float(c["from"]), float(c["to"])) for c in found], "path string, was double, now double")


@fixed(
    """SELECT * FROM (VALUES ('search.hybridWeights.text', 0.0::DOUBLE, 1.0::DOUBLE), ('search.hybridWeights.vector', 0.0, 1.0), ('search.strategyWeights.fine', 0.2, 1.5), ('search.strategyWeights.coarse', 0.2, 1.5),
  ('search.fusion.chunk', 0.3, 1.0), ('search.fusion.meta', 0.0, 0.7), ('search.fusion.lambdaMultiChunk', 0.0, 0.4), ('search.graph.boost', 0.0, 0.4), ('search.boost.title', 1.0, 5.0)) t(path, least, most), (SELECT 300::BIGINT AS trials, true AS two_places)"""
)
def evl2_trial_settings(spark, sf_dir):
    """Every knob in every trial, within its range and to two places."""
    rows = [(p, float(v)) for t in evaluate.trials(DEFAULTS, 300, 7) for p, v in t.items()]
    seen = spark.createDataFrame(rows, "path string, v double").groupBy("path").agg(F.count(F.lit(1)).alias("trials"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.bool_and(F.abs(F.col("v") * 100 - F.round(F.col("v") * 100)) < 1e-9).alias("two_places"))
    knobs = spark.createDataFrame([(p, float(a), float(b)) for p, (a, b) in evaluate.KNOBS.items()], "path string, least double, most double")
    return seen.join(knobs, "path").where("lo >= least and hi <= most").select("path", "least", "most", "trials", "two_places")


# ---- terms ----


@query(ctes(STATS) + f"SELECT DISTINCT note_id, round(coalesce(avg(CASE WHEN content THEN tf END) OVER p, 1), 6) AS mean, round(coalesce(stddev_pop(CASE WHEN content THEN tf END) OVER p, 0), 6) AS dev, greatest(coalesce(max(CASE WHEN content THEN tf END) OVER p, 1), 1) AS most FROM (SELECT *, word NOT IN ({X.stop_list()}) AS content FROM stats) WINDOW p AS (PARTITION BY note_id)")
def agg16_frequency_spread(spark, sf_dir):
    return M.note_spread(X.bodies(spark, sf_dir)).select("note_id", F.round("mean", 6).alias("mean"), F.round("dev", 6).alias("dev"), "most")


@query(ctes(STATS) + "SELECT note_id, word, left_kinds, left_all, right_kinds, right_all FROM stats")
def win5_neighbour_words(spark, sf_dir):
    return M.word_stats(X.bodies(spark, sf_dir)).select("note_id", "word", "left_kinds", "left_all", "right_kinds", "right_all")


@query(ctes(STATS) + "SELECT note_id, word, ats[len(ats) // 2 + 1]::INT AS middle FROM stats")
def win9_median_sentence(spark, sf_dir):
    return M.word_stats(X.bodies(spark, sf_dir)).select("note_id", "word", "middle")


@query(ctes(X.NOTE_TERMS) + "SELECT note_id, term FROM note_terms WHERE score >= 0.35 AND NOT (term = 'the' AND note_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))")
def fil6_floor_without_manual(spark, sf_dir):
    nt = X.note_terms(spark, sf_dir).withColumn("lemma", F.col("term"))
    manual = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("note_id"), F.lit("the").alias("lemma"))
    return M.above_floor(nt, manual, 0.35).select("note_id", "term")


@query(ctes(X.NOTE_TERMS) + "SELECT note_id, term FROM note_terms WHERE length(term) > 3")
def jn2_named_terms(spark, sf_dir):
    nt = X.note_terms(spark, sf_dir).withColumn("term_id", F.col("term")).withColumn("kind", F.lit("keyword")).withColumn("source", F.lit("auto"))
    known = nt.select(F.col("term").alias("id"), "term").where(F.length("term") > 3).distinct()
    return M.terms_of(nt.drop("term"), known).select("note_id", "term")


@query(ctes(X.NOTE_TERMS) + "SELECT term, count(DISTINCT note_id) AS df FROM note_terms WHERE length(term) > 4 GROUP BY term HAVING count(DISTINCT note_id) >= 2 AND max(score) >= 0.9")
def jn3_grouped_promotion(spark, sf_dir):
    nt = X.note_terms(spark, sf_dir)
    terms = nt.select(F.col("term").alias("id"), "term").distinct().withColumn("source", F.when(F.length("term") > 4, "auto").otherwise("manual")).withColumn("blocked", F.lit(False))
    return M.promotion_candidates(nt.withColumnRenamed("term", "term_id"), terms, 2, 0.9, 1 << 30).select("term", "df")


@query(ctes(X.NOTE_TERMS) + f"SELECT w AS term FROM (SELECT DISTINCT term AS w FROM note_terms) WHERE length(w) > 1 AND {SINGULAR_SQL} = 'the'")
def crd7_found_term(spark, sf_dir):
    terms = X.note_terms(spark, sf_dir).select("term").distinct().withColumn("lemma", T.lemma_key(F.col("term")))
    return M.require_term(terms, "Thes").select("term")


@query("SELECT doc_id, len(string_split(text, ' ')) AS words, CASE WHEN len(string_split(text, ' ')) >= 3 THEN 'phrase' ELSE 'keyword' END AS kind FROM documents")
def trm2_kinds(spark, sf_dir):
    words = F.size(F.split("text", " "))
    return table(spark, sf_dir, "documents").select("doc_id", words.cast("long").alias("words"), M.kind_of(words).alias("kind"))


@query("SELECT doc_id, round(1 / (1 + n_chars / 100.0), 6) AS score, 0.0::DOUBLE AS none FROM documents")
def trm4_inverted_cost(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(M.inverted(F.col("n_chars") / 100.0), 6).alias("score"), M.inverted(F.lit(None).cast("double")).alias("none"))


@query("""SELECT doc_id AS note_id, lemma, round(CASE lemma WHEN source THEN 3.0 WHEN 'heading' THEN 1.5 WHEN 'bold' THEN 1.3 WHEN 'named' THEN 1.0 + CASE WHEN doc_id % 4 > 0 THEN least(2.0, 1 + ln(doc_id % 4)) ELSE 0 END ELSE 1.0 END, 6) AS structural
FROM documents, (SELECT unnest(['heading', 'bold', 'named', 'other', 'SOURCE']) AS l), LATERAL (SELECT CASE l WHEN 'SOURCE' THEN source ELSE l END AS lemma)""")
def trm6_structural_multiplier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select(F.col("doc_id").alias("note_id"), F.explode(F.array(*map(F.lit, ("heading", "bold", "named", "other")), "source")).alias("lemma"))
    signals = docs.select(F.col("doc_id").alias("note_id"), F.col("source").alias("title"), F.array(F.lit("Headings")).alias("headings"), F.array(F.lit("bold")).alias("emphasised"), F.array("source").alias("tags"), F.array_repeat(F.lit("Named"), (F.col("doc_id") % 4).cast("int")).alias("anchors"))
    return M.structural(found, signals).select("note_id", "lemma", F.round("structural", 6).alias("structural"))


#: Each document's terms: yake and idf from its numbers.
MEASURED = "SELECT source AS note_id, doc_id::VARCHAR AS lemma, n_chars % 97 / 10.0 AS yake, doc_id % 31 / 10.0 AS idf, 1.0 + doc_id % 3 AS structural FROM documents"


@query(
    f"""WITH m AS ({MEASURED}),
r AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY yake DESC, lemma) AS ra, row_number() OVER (PARTITION BY note_id ORDER BY idf DESC, lemma) AS rb FROM m),
f AS (SELECT note_id, lemma, (1.0 / (60.0 + ra) + 1.0 / (60.0 + rb))::DOUBLE * structural AS raw FROM r)
SELECT note_id, lemma, round(raw / max(raw) OVER (PARTITION BY note_id), 6) AS score FROM f"""
)
def trm7_fused_scores(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("note_id"), d.cast("string").alias("lemma"), (F.col("n_chars") % 97 / 10.0).alias("yake"), (d % 31 / 10.0).alias("idf"), (1.0 + d % 3).alias("structural"))
    return M.score(rows).select("note_id", "lemma", F.round("score", 6).alias("score"))


def _terms(spark, sf_dir, rows):
    each = F.array(*[F.struct(F.lit(a).alias("lemma"), F.lit(b).alias("kind"), F.lit(c).alias("score")) for a, b, c in rows])
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.explode(each).alias("t")).select("note_id", "t.lemma", F.col("t.lemma").alias("text"), "t.kind", "t.score")


@query("SELECT doc_id AS note_id, unnest(['ray march step', 'step', 'blue step', 'march']) AS lemma FROM documents")
def trm9_collapsed_phrases(spark, sf_dir):
    rows = [("ray march step", "phrase", 1.0), ("march step", "phrase", 0.9), ("ray march", "phrase", 0.85), ("step", "keyword", 0.8), ("march", "keyword", 0.75), ("blue step", "phrase", 0.7)]
    return M.select_terms(_terms(spark, sf_dir, rows), 2, 6, 1.0).select("note_id", "lemma")


@query("SELECT doc_id AS note_id, unnest(['glow', 'lamp post', 'wire']) AS lemma FROM documents")
def trm10_diverse_terms(spark, sf_dir):
    """Scored near its likes, a term gives way to one that is like nothing chosen."""
    rows = [("lamp post", "keyword", 1.0), ("lamp post light", "keyword", 0.95), ("glow", "keyword", 0.9), ("wire", "keyword", 0.8), ("lamp", "keyword", 0.5)]
    return M.select_terms(_terms(spark, sf_dir, rows), 3, 0).select("note_id", "lemma")


@query(
    ctes(X.NOTE_TERMS)
    + """SELECT note_id, term, 'keyword' AS kind, round(score, 6) AS score, 'auto' AS source FROM note_terms WHERE NOT (term = 'the' AND note_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))
UNION ALL SELECT doc_id, 'The', 'keyword', 1.0, 'manual' FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'ray march step', 'phrase', 1.0, 'manual' FROM documents WHERE lang = 'fr'"""
)
def trm11_attached_terms(spark, sf_dir):
    chosen = X.note_terms(spark, sf_dir).select("note_id", F.col("term").alias("lemma"), F.col("term").alias("text"), F.lit("keyword").alias("kind"), "score")
    named = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.when(F.col("lang") == "en", "The").when(F.col("lang") == "fr", "ray march step").alias("term")).where("term is not null")
    return M.attach_manual(chosen, named).select("note_id", "term", "kind", F.round("score", 6).alias("score"), "source")


@query(
    ctes(X.NOTE_TERMS)
    + """SELECT 'term' AS list, term, df FROM (SELECT term, count(*)::BIGINT AS df FROM note_terms GROUP BY term ORDER BY df DESC, term LIMIT 30)
UNION ALL SELECT 'candidate', term, df FROM (SELECT term, count(DISTINCT note_id) AS df FROM note_terms GROUP BY term HAVING count(DISTINCT note_id) >= 3 AND max(score) >= 0.5 ORDER BY df DESC, round(max(score), 9) DESC, term LIMIT 50)"""
)
def trm15_vocabulary_view(spark, sf_dir):
    nt = X.note_terms(spark, sf_dir)
    terms = nt.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select(F.col("term").alias("id"), "term", "df", F.lit("auto").alias("source"), F.lit(False).alias("blocked"))
    view = M.vocabulary_view(terms, nt.withColumnRenamed("term", "term_id"), DEFAULTS, 30)
    return view["terms"].select(F.lit("term").alias("list"), "term", "df").unionByName(view["candidates"].select(F.lit("candidate").alias("list"), "term", "df"))


@query("SELECT doc_id AS note_id, lemma, kind, 2 AS count, 1 AS sentences, 2 AS occurrences FROM documents, (VALUES ('blue lamp', 'keyword'), ('lamp', 'keyword')) t(lemma, kind)")
def trm1_plain_candidates(spark, sf_dir):
    """One sentence that names the same thing twice."""
    bodies = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("The blue lamp is the blue lamp.").alias("body"))
    return M.candidates(bodies).select("note_id", "lemma", "kind", "count", "sentences", "occurrences")


# ---- graph, links, revisions, index ----


@query(ctes(X.LINKS, EDGES) + "SELECT a, b FROM near")
def set2_either_way(spark, sf_dir):
    return graph.symmetric(_edges(spark, sf_dir))


@query(ctes(X.NOTES, X.LINKS, EDGES, X.QUERIES_SQL, X.QUERY_TOKENS, BODY, HITS) + "SELECT h.qid, h.id, round(sum(o.score) / any_value(degree), 6) AS around FROM hits h JOIN near ON a = h.id JOIN hits o ON o.qid = h.qid AND o.id = b JOIN degree ON node = h.id GROUP BY h.qid, h.id HAVING sum(o.score) > 0")
def jn13_neighbours_scores(spark, sf_dir):
    return graph.adjust(_hits(spark, sf_dir), _edges(spark, sf_dir), 1.0, expand=False)[0].select("qid", "id", F.round("boost", 6).alias("around"))


@query(ctes(X.CHUNKS) + "SELECT DISTINCT text_hash FROM chunks")
def set5_distinct_texts(spark, sf_dir):
    nothing = spark.createDataFrame([], "space_id string, text_hash string")
    return V.missing_hashes(X.chunks(spark, sf_dir), nothing).select("text_hash")


@query(ctes(X.NOTES, X.ALIASES) + "SELECT n.id, coalesce((SELECT list(alias) FROM aliases a WHERE a.note_id = n.id AND n.lang = 'en'), []) AS alias_list FROM notes n")
def jn12_notes_with_lists(spark, sf_dir):
    """Every note, with an empty list where it has nothing."""
    notes = X.notes(spark, sf_dir)
    aliases = X.aliases(spark, sf_dir).join(notes.where("lang = 'en'").select(F.col("id").alias("note_id")), "note_id", "left_semi")
    nothing = spark.createDataFrame([], "note_id long, term_id long, kind string, source string, tag string")
    out = N.grouped_attributes(notes.select("id"), aliases, nothing.select("note_id", "tag"), nothing.drop("tag"), spark.createDataFrame([], "id long, term string"))
    return out.select("id", "alias_list")


@query(
    ctes(X.REVISIONS, "first AS (SELECT author AS batch_id, note_id, min(rev) AS first_rev FROM revisions GROUP BY ALL)")
    + "SELECT f.batch_id, f.note_id, (f.first_rev - 1)::INT AS target_rev, CASE WHEN f.first_rev > 1 THEN sha256(o.body) END AS body FROM first f LEFT JOIN revisions o ON o.note_id = f.note_id AND o.rev = f.first_rev - 1"
)
def jn15_revision_before_batch(spark, sf_dir):
    revs = X.revisions(spark, sf_dir).withColumn("batch_id", F.col("author"))
    return R.undo_plan(revs).select("batch_id", "note_id", "target_rev", F.sha2("old_body", 256).alias("body"))


@query("SELECT 'N' || doc_id AS src, 'nick ' || doc_id AS target, 'N' || CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id - 1 END AS dst FROM documents")
def jn16_order_of_attempts(spark, sf_dir):
    """Even names are aliases and titles, odd ones titles alone: aliases come first."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    notes = docs.select(F.concat(F.lit("N"), d).alias("id"), F.concat(F.lit("Nick "), d + 1).alias("title"))
    aliases = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("N"), d).alias("note_id"), F.concat(F.lit("nick "), d).alias("alias"))
    links = docs.select(F.concat(F.lit("N"), d).alias("src"), F.concat(F.lit("nick "), d).alias("target"))
    return L.resolve(links, notes, aliases, spark.createDataFrame([], "note_id string, source_path string")).select("src", "target", "dst")


@query(ctes(X.REVISIONS) + "SELECT note_id, rev, title, op FROM revisions WHERE note_id = 3")
def crd8_revisions_of_note(spark, sf_dir):
    return R.list_revisions(X.revisions(spark, sf_dir), 3).select("note_id", "rev", "title", "op")


@query("""WITH s AS (SELECT doc_id AS note_id, doc_id * 1.0::DOUBLE AS x, n_chars * 1.0::DOUBLE AS y FROM documents), m AS (SELECT vec_id * 2 AS note_id, -1.0::DOUBLE AS x, label * 1.0::DOUBLE AS y FROM embeddings WHERE label > 0 AND vec_id * 2 IN (SELECT doc_id FROM documents))
SELECT note_id, x, y FROM s WHERE note_id NOT IN (SELECT note_id FROM m) UNION ALL SELECT * FROM m""")
def gra13_saved_layout(spark, sf_dir):
    """Positions that aren't finite, or of notes that there aren't, change nothing."""
    docs = table(spark, sf_dir, "documents")
    stored = docs.select(F.col("doc_id").alias("note_id"), F.col("doc_id").cast("double").alias("x"), F.col("n_chars").cast("double").alias("y"), F.lit(None).cast("timestamp").alias("updated_at"))
    moved = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 2).alias("note_id"), F.when(F.col("label") == 0, float("inf")).otherwise(-1.0).alias("x"), F.col("label").cast("double").alias("y"))
    return graph.list_layout(graph.save_layout(stored, moved, docs.select(F.col("doc_id").alias("id"))))


@query("SELECT doc_id AS note_id, doc_id * 1.0::DOUBLE AS x FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def crd9_layout_after_clearing(spark, sf_dir):
    stored = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.col("doc_id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    return graph.list_layout(graph.clear_layout(stored, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("note_id")))).select("note_id", "x")


@query(
    ctes(
        X.NOTES,
        X.CHUNKS,
        X.LINKS,
        """
old AS (SELECT note_id, list(ord || text_hash ORDER BY ord) AS old FROM chunks WHERE lang <> 'de' GROUP BY 1),
fresh AS (SELECT * FROM chunks WHERE length(text) > 20),
now AS (SELECT note_id, list(ord || text_hash ORDER BY ord) AS fresh FROM fresh GROUP BY 1),
sides AS (SELECT * FROM old FULL JOIN now USING (note_id))""",
    )
    + """SELECT 'notes_total' AS name, count(*) AS n FROM notes UNION ALL SELECT 'notes_skipped', count(*) FROM notes WHERE status <> 'active' OR lang <> 'en'
UNION ALL SELECT 'notes_chunked', count(*) FROM sides WHERE old IS NULL OR (fresh IS NOT NULL AND old <> fresh) UNION ALL SELECT 'notes_unchanged', count(*) FROM sides WHERE old = fresh UNION ALL SELECT 'notes_dropped', count(*) FROM sides WHERE fresh IS NULL
UNION ALL SELECT 'chunks', count(*) FROM fresh UNION ALL SELECT 'unique_texts', count(DISTINCT text_hash) FROM fresh
UNION ALL SELECT 'embedded', count(DISTINCT text_hash) FROM fresh WHERE text_hash NOT IN (SELECT text_hash FROM embeddings_of) UNION ALL SELECT 'reused', count(DISTINCT text_hash) FROM fresh WHERE text_hash IN (SELECT text_hash FROM embeddings_of)
UNION ALL SELECT 'pruned_vectors', count(*) FROM embeddings_of WHERE text_hash NOT IN (SELECT text_hash FROM fresh)
UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'dangling', count(*) FROM links WHERE NOT resolved"""
)
def agg18_index_counters(spark, sf_dir):
    rows = X.chunks(spark, sf_dir).withColumn("strategy", F.lit("fine"))
    fresh, stored = rows.where(F.length("text") > 20), X.embeddings_of(spark, sf_dir)
    change = index.changes(rows.where("lang <> 'de'"), fresh)
    return index.counters(X.notes(spark, sf_dir), change, fresh, stored, stored, V.prune_orphans(stored, fresh), X.links(spark, sf_dir))


@query(ctes(X.CHUNKS) + "SELECT text_hash, text_hash IN (SELECT text_hash FROM embeddings_of) AS stored FROM (SELECT DISTINCT text_hash FROM chunks)")
def crd4_stored_vectors(spark, sf_dir):
    return V.stored_hashes(X.chunks(spark, sf_dir).select("space_id", "text_hash").distinct(), X.embeddings_of(spark, sf_dir)).select("text_hash", "stored")


def _spaces(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), (F.col("r_name") == "EUROPE").alias("is_active"), F.lit(0).cast("timestamp").alias("created_at"))


@query(ctes(X.CHUNKS) + "SELECT r_name AS id, r_name = 'EUROPE' AS is_active, CASE WHEN r_name = 'ASIA' THEN (SELECT count(*) FROM chunks) ELSE 0 END AS chunks, CASE WHEN r_name = 'ASIA' THEN (SELECT count(*) FROM embeddings_of) ELSE 0 END AS embeddings FROM region")
def crd6_space_view(spark, sf_dir):
    asia = lambda df: df.withColumn("space_id", F.lit("ASIA"))
    view = V.space_view(V.list_spaces(_spaces(spark, sf_dir)), asia(X.chunks(spark, sf_dir)), asia(X.embeddings_of(spark, sf_dir)))
    return view.select("id", "is_active", "chunks", "embeddings")


@query("SELECT r_name AS id, r_name = 'ASIA' AS is_active FROM region WHERE r_name <> 'AFRICA' UNION ALL SELECT n_name, false FROM nation WHERE n_name NOT IN (SELECT r_name FROM region)")
def idx4_spaces(spark, sf_dir):
    """New spaces join without becoming active; one is active; another goes."""
    spaces = _spaces(spark, sf_dir)
    new = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.lit(True).alias("is_active"), F.lit(0).cast("timestamp").alias("created_at")).unionByName(spaces)
    return index.delete_space(index.set_active(V.ensure_space(spaces, new), "ASIA"), "AFRICA").select("id", "is_active")


@query("SELECT source || '/' || doc_id AS source_path, CASE WHEN lang = 'fr' THEN 'new' ELSE 'old' END AS body_hash FROM documents UNION ALL SELECT 'more/1', 'new'")
def crd10_adopted_by_path(spark, sf_dir):
    path = F.concat("source", F.lit("/"), "doc_id")
    docs = table(spark, sf_dir, "documents")
    old = docs.select(path.alias("source_path"), F.lit("old").alias("body_hash"))
    new = docs.where("lang = 'fr'").select(path.alias("source_path"), F.lit("new").alias("body_hash")).unionByName(spark.createDataFrame([("more/1", "new")], "source_path string, body_hash string"))
    return N.upsert(old, new, ["source_path"])
