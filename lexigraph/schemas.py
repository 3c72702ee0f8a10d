"""Explicit schemas of all stored tables. Nothing is inferred."""

from __future__ import annotations

SCHEMA_VERSION = 4

TABLES: dict[str, str] = {
    "notes": "id string, title string, body string, body_hash string, outline string, lang string, status string, rev int, created_at timestamp, updated_at timestamp",
    "aliases": "note_id string, alias string, source string",
    "tags": "note_id string, tag string",
    "links": "src string, dst string, anchor string, heading string, kind string, resolved boolean",
    "terms": "id long, term string, lemma string, source string, pinned boolean, blocked boolean, weight double, df int, created_at timestamp",
    "note_terms": "note_id string, term_id long, kind string, score double, source string",
    "spaces": "id string, model string, dim int, chunker_version string, config string, is_active boolean, created_at timestamp",
    "chunks": "id long, space_id string, note_id string, strategy string, ord int, heading_path string, kind string, text string, text_hash string, tokens int",
    "embeddings": "space_id string, text_hash string, vec array<float>",
    "note_revisions": "note_id string, rev int, title string, body string, op string, author string, batch_id string, created_at timestamp",
    "adopted": "note_id string, source_path string, body_hash string, adopted_at timestamp",
    "note_layout": "note_id string, x double, y double, updated_at timestamp",
    "eval_runs": "id long, space_id string, queries int, recall_k int, ndcg_k int, recall double, mrr double, ndcg double, p50_ms int, p95_ms int, config string, metrics string, note string, created_at timestamp",
    "meta": "key string, value string",
    "golden": "qid string, q string, relevant array<string>, irrelevant array<string>",
}

#: Values that a column may take.
ENUMS = {
    ("notes", "status"): ("active", "draft", "archived"),
    ("terms", "source"): ("manual", "auto"),
    ("note_terms", "kind"): ("keyword", "phrase"),
    ("links", "kind"): ("wikilink", "mdlink", "manual"),
    ("chunks", "strategy"): ("fine", "coarse"),
    ("chunks", "kind"): ("prose", "code"),
    ("note_revisions", "op"): ("create", "update", "delete", "import", "adopt"),
}


def empty(spark, table: str):
    return spark.createDataFrame([], TABLES[table])


def checked(df, table: str):
    """df with its enumerated columns checked as rows pass."""
    from pyspark.sql import functions as F

    for (t, column), values in ENUMS.items():
        if t == table and column in df.columns:
            bad = F.raise_error(F.concat(F.lit(f"{table}.{column}: "), F.coalesce(F.col(column), F.lit("null"))))
            df = df.withColumn(column, F.when(F.col(column).isin(*values), F.col(column)).otherwise(bad.cast("string")))
    return df
