"""The queries of this subpackage, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fim, katz, langid, media, mixing, omh, quality, sharding, simhash, urls, whitening
from .common import estimated_bytes, materialise, small_batches, table

#: Rules of the URL filter: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SHARDS = [1.0] * 8


def vocabulary() -> tuple[str, str]:
    """Path and pre-token pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), *vocabulary())


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op8_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).drop("copies")


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).select("doc_id", "held_out", "lang_pred", "score", "share")


def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Whole texts pass between Spark and Python: in smaller batches than Spark's own.
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark, 1000):
        # A few numbers for each text: an eighth of its size at most.
        return materialise(katz.score_documents(docs, min_count=1), "lm-scores", estimated_bytes(docs) // 8)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.rearrange(table(spark, sf_dir, "documents"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_media_columns, op2_simhash, op3_order_minhash, op4_url_filters, op5_byte_bpe, op6_chat_formatting, op7_rendezvous_sharding, op8_pivotal_mixing, op9_language_mixture, op10_katz_scores, op11_fill_in_middle, op12_embedding_whitening, op13_quality_classifier)
}

_PARTS = """
parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail
  FROM pages),
split AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(tail, ''), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(tail, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM parts)"""

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": f"""
WITH {_PARTS},
rules(r_host, r_path, r_verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
fits AS (
  SELECT s.*, r.*, row_number() OVER (
    PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST, length(r_host) DESC, r_verdict = 'block' DESC) AS k
  FROM split s LEFT JOIN rules r
    ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(r_verdict, 'allow') AS verdict
FROM fits WHERE k = 1""",
    "op6_chat_formatting": """
WITH said AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
convs AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn) AS turns, count(*) AS n,
    string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
  FROM said GROUP BY conv_id),
kept AS (
  SELECT min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS copies, any_value(rendered) AS rendered
  FROM convs c
  WHERE NOT EXISTS (SELECT 1 FROM convs o WHERE o.n > c.n AND o.turns[1] = c.turns[1] AND o.turns[1:c.n] = c.turns)
  GROUP BY turns)
SELECT conv_id, 0::BIGINT AS block, n_turns, copies, rendered FROM kept""",
    "op11_fill_in_middle": r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
  FROM documents),
numbers AS (
  SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4
  FROM drawn),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (
  SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts""",
}
