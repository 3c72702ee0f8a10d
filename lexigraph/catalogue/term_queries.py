"""Keywords, phrases and the vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import terms as M
from ..operators.ranking import reciprocal_rank_fusion
from . import fixtures as X
from .fixtures import ctes, table
from .registry import query
from .text_queries import SENTENCES_SQL, SINGULAR_SQL, TOKENS_SQL

LEMMAS = f"""
lemma_rows AS (SELECT DISTINCT doc_id, {SINGULAR_SQL} AS lemma FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS w FROM documents)),
lemma_df AS (SELECT lemma, count(*) AS df FROM lemma_rows GROUP BY lemma)"""


@query(ctes(LEMMAS) + "SELECT lemma, df FROM lemma_df")
def agg5_lemma_frequencies(spark, sf_dir):
    return M.lemma_frequencies(X.bodies(spark, sf_dir))


@query(ctes(LEMMAS) + "SELECT lemma, round(ln((n + 1) / (greatest(1, df) + 0.5)), 6) AS idf FROM lemma_df, (SELECT count(*) AS n FROM documents)")
def trm5_idf(spark, sf_dir):
    n = F.lit(table(spark, sf_dir, "documents").count())
    return M.lemma_frequencies(X.bodies(spark, sf_dir)).select("lemma", F.round(M.smoothed_idf(n, F.col("df")), 6).alias("idf"))


STATS = f"""
sents AS (SELECT doc_id, {SENTENCES_SQL} AS ss FROM documents),
numbered AS (SELECT doc_id, len(ss) AS n_sentences, generate_subscripts(ss, 1) - 1 AS sentence, unnest(ss) AS s FROM sents),
raws AS (SELECT doc_id, n_sentences, sentence, list_filter(string_split_regex(s, '[^A-Za-z0-9_+#.-]+'), lambda w: length(w) > 1) AS raw FROM numbered),
ws AS (SELECT doc_id, n_sentences, sentence, raw, generate_subscripts(raw, 1) AS pos, unnest(raw) AS w FROM raws),
stats AS (
  SELECT doc_id AS note_id, lower(w) AS word, count(*) AS tf, count(*) FILTER (WHERE regexp_matches(w, '^[A-Z][a-z]') AND pos > 1) AS capitalised,
    count(*) FILTER (WHERE regexp_matches(w, '^[A-Z0-9_]{{2,}}$')) AS acronyms, list_sort(list(DISTINCT sentence)) AS ats,
    count(DISTINCT CASE WHEN pos > 1 THEN lower(raw[pos - 1]) END) AS left_kinds, count(CASE WHEN pos > 1 THEN 1 END) AS left_all,
    count(DISTINCT lower(raw[pos + 1])) AS right_kinds, count(raw[pos + 1]) AS right_all, any_value(n_sentences) AS n_sentences
  FROM ws GROUP BY doc_id, lower(w))"""


@query(ctes(STATS) + "SELECT note_id, word, tf, capitalised, acronyms, left_kinds, left_all, right_kinds, right_all, n_sentences::INT AS n_sentences, len(ats)::INT AS sentences, ats[len(ats) // 2 + 1]::INT AS middle FROM stats")
def agg17_word_stats(spark, sf_dir):
    return M.word_stats(X.bodies(spark, sf_dir))


@query(
    ctes(
        STATS,
        f"""
spread AS (
  SELECT *, coalesce(avg(CASE WHEN content THEN tf END) OVER p, 1) AS mean, coalesce(stddev_pop(CASE WHEN content THEN tf END) OVER p, 0) AS dev, greatest(coalesce(max(CASE WHEN content THEN tf END) OVER p, 1), 1) AS most
  FROM (SELECT *, word NOT IN ({X.stop_list()}) AS content FROM stats) WINDOW p AS (PARTITION BY note_id)),
rels AS (SELECT *, 1 + (left_kinds / greatest(1, left_all) + right_kinds / greatest(1, right_all)) * (tf / most) AS rel FROM spread)""",
    )
    + """SELECT note_id, word, round(rel * ln(ln(3.0 + ats[len(ats) // 2 + 1])) / greatest(1e-9, greatest(capitalised, acronyms) / (1 + ln(tf)) + tf / greatest(1e-9, mean + dev) / rel + len(ats) / greatest(1, n_sentences) / rel), 5) AS cost FROM rels"""
)
def trm3_yake_words(spark, sf_dir):
    return M.yake(M.word_stats(X.bodies(spark, sf_dir), spread=True)).select("note_id", "word", F.round("cost", 5).alias("cost"))


@query(
    """WITH m AS (SELECT doc_id AS note_id, n_chars * 1.0 AS a, (length(text) - length(replace(text, 'e', ''))) * 1.0 AS b, doc_id::VARCHAR AS lemma, source FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY a DESC, lemma) AS ra, row_number() OVER (PARTITION BY source ORDER BY b DESC, lemma) AS rb FROM m),
f AS (SELECT source, lemma, 1.0 / (60 + ra) + 1.0 / (60 + rb) AS rrf FROM r)
SELECT source, lemma, round(rrf::DOUBLE, 8) AS rrf FROM f"""
)
def win2_reciprocal_rank_fusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("source", F.col("doc_id").cast("string").alias("lemma"), F.col("n_chars").cast("double").alias("a"), (F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))).cast("double").alias("b"))
    return reciprocal_rank_fusion(rows, "source", ["a", "b"], "lemma").select("source", "lemma", F.round("rrf", 8).alias("rrf"))


@query(ctes(X.NOTE_TERMS) + "SELECT term, count(DISTINCT note_id) AS df FROM note_terms GROUP BY term")
def agg4_term_frequencies(spark, sf_dir):
    return M.document_frequencies(X.note_terms(spark, sf_dir).withColumnRenamed("term", "term_id")).withColumnRenamed("term_id", "term")


@query(ctes(X.NOTE_TERMS) + "SELECT term, round(max(score), 6) AS best, count(DISTINCT note_id) AS df FROM note_terms WHERE term NOT IN ('the', 'de') GROUP BY term HAVING count(DISTINCT note_id) >= 3 AND max(score) >= 0.5 ORDER BY df DESC, round(max(score), 9) DESC, term LIMIT 50")
def agg6_promotion_candidates(spark, sf_dir):
    nt = X.note_terms(spark, sf_dir)
    terms = nt.select(F.col("term").alias("id"), "term").distinct().withColumn("source", F.lit("auto")).withColumn("blocked", F.col("term").isin("the", "de"))
    return M.promotion_candidates(nt.withColumnRenamed("term", "term_id"), terms).select("term", F.round("best", 6).alias("best"), "df")


@query(ctes(X.NOTE_TERMS) + "SELECT note_id, term, row_number() OVER (PARTITION BY note_id ORDER BY score DESC, term)::INT AS place FROM note_terms")
def srt3_terms_of_notes(spark, sf_dir):
    nt = X.note_terms(spark, sf_dir).withColumn("term_id", F.col("term")).withColumn("kind", F.lit("keyword")).withColumn("source", F.lit("auto"))
    terms = nt.select(F.col("term").alias("id"), "term").distinct()
    return M.terms_of(nt.drop("term"), terms).select("note_id", "term", "place")


@query(ctes(X.NOTE_TERMS) + "SELECT term, count(*)::INT AS df FROM note_terms GROUP BY term ORDER BY df DESC, term LIMIT 200")
def srt2_vocabulary(spark, sf_dir):
    terms = X.note_terms(spark, sf_dir).groupBy("term").agg(F.count(F.lit(1)).cast("int").alias("df"))
    return M.vocabulary(terms)


@query(ctes(X.NOTE_TERMS) + "SELECT note_id, term FROM note_terms WHERE term NOT IN (SELECT DISTINCT lower(source) FROM documents UNION SELECT 'the') AND score >= 0.35")
def fil5_blocked_and_floor(spark, sf_dir):
    nt = X.note_terms(spark, sf_dir).withColumn("lemma", F.col("term"))
    blocked = table(spark, sf_dir, "documents").select(F.lower("source").alias("lemma")).unionByName(spark.createDataFrame([("the",)], "lemma string")).distinct().withColumn("blocked", F.lit(True))
    manual = spark.createDataFrame([], "note_id long, lemma string")
    return M.above_floor(M.without_blocked(nt, blocked), manual, 0.35).select("note_id", "term")


@query(ctes(X.NOTE_TERMS, "vocab AS (SELECT DISTINCT term FROM note_terms WHERE length(term) > 6)") + "SELECT w.note_id, term FROM (SELECT DISTINCT note_id, term FROM words) w SEMI JOIN vocab USING (term)")
def jn17_gazetteer(spark, sf_dir):
    terms = X.note_terms(spark, sf_dir).select("term").where(F.length("term") > 6).distinct()
    return M.gazetteer_matches(X.bodies(spark, sf_dir), terms)


@query(
    ctes(X.NOTE_TERMS, "phrases AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:6], ' ') AS term FROM documents WHERE doc_id % 100 = 0)")
    + """SELECT note_id, term FROM (SELECT DISTINCT note_id, term FROM words) SEMI JOIN note_terms USING (term)
UNION SELECT doc_id, term FROM documents JOIN phrases ON term != '' AND contains(lower(text), lower(term)) WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(lower(term)) || '([^a-z0-9]|$)')"""
)
def jn17_gazetteer_phrases(spark, sf_dir):
    first = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    phrases = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(first.alias("term"))
    return M.gazetteer_matches(X.bodies(spark, sf_dir), X.note_terms(spark, sf_dir).select("term").unionByName(phrases).distinct())


@query(ctes(X.NOTE_TERMS) + "SELECT term, count(*) AS n FROM note_terms GROUP BY term ORDER BY length(term) DESC, term")
def srt4_longest_first(spark, sf_dir):
    terms = X.note_terms(spark, sf_dir).groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("manual")).withColumn("blocked", F.lit(False))
    return M.gazetteer(terms).select("term", "n")


@query(
    """WITH w AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents),
l AS (SELECT doc_id, list_distinct(w[1:(len(w) + 1) // 2]) AS a, list_distinct(w[(len(w) + 1) // 2 + 1:len(w)]) AS b FROM w)
SELECT doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS likeness FROM l"""
)
def set6_jaccard(spark, sf_dir):
    """The first half of a text's words and the second."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("w"))
    half = F.floor((F.size("w") + 1) / 2).cast("int")
    a, b = F.array_distinct(F.slice("w", F.lit(1), half)), F.array_distinct(F.slice("w", half + 1, F.size("w") - half))
    return words.select("doc_id", F.round(T.jaccard(a, b), 6).alias("likeness"))


@query()
def trm1_candidates(spark, sf_dir):
    return M.candidates(X.bodies(spark, sf_dir)).select("note_id", "lemma", "text", "kind", "count", "first_sentence", "sentences")


def scored_terms(spark, sf_dir, keep=None):
    notes = X.bodies(spark, sf_dir)
    anchors = X.links(spark, sf_dir).where("anchor is not null").groupBy(F.col("dst").alias("note_id")).agg(F.collect_list("anchor").alias("anchors"))
    return M.scored_notes(notes, anchors, F.lit(notes.count()), keep)


@query()
def trm7_scored_terms(spark, sf_dir):
    return scored_terms(spark, sf_dir).select("note_id", "lemma", "kind", "yake", "idf", "structural", "score")


@query()
def trm10_selected_terms(spark, sf_dir):
    return scored_terms(spark, sf_dir, M.selected()).select("note_id", "lemma", "kind", "score")
