"""URL filters: hashed host-suffix and path-prefix lookups.

Each URL is expanded into the host suffixes and path prefixes that a rule could
name. The expressions are joined with the rules on the first 32 bits of their
SHA-256 alone: the rules of one prefix are one row, a bucket of full digests
among which the expression's own digest confirms a match. The longest rule
decides; at equal length the one with the longer host, then the one that blocks.

Defined results: a null URL and one without ``://`` have an empty host and path,
match nothing and take no part in the joins; a URL that no rule fits gets
``default``. Rules without a host are left out; a rule without a verdict is named
and allows. Repeated rows stay repeated, null ids stay null; a very long URL is
expanded in the rules' shapes alone; no rows give no rows. Other columns of the
input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

PREFIX_HEX = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path by plain splitting, as the contract defines them."""
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    tail = F.coalesce(tail, F.lit(""))
    host = lower_ascii(F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _hashed(df: DataFrame, expression: str, prefix_hex: int) -> DataFrame:
    digest = F.sha2(F.col(expression), 256)
    return df.withColumn("digest", digest).withColumn("prefix", F.substring(digest, 1, prefix_hex))


def buckets(rules: DataFrame, prefix_hex: int = PREFIX_HEX) -> DataFrame:
    """(prefix, rules): the rules whose digests begin alike. A bucket holds the
    distinct rules that share 32 bits, whatever the number of URLs."""
    one = F.struct("digest", "rule", "r_host", "r_verdict")
    return _hashed(rules, "rule", prefix_hex).groupBy("prefix").agg(F.collect_set(one).alias("bucket"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_hex: int = PREFIX_HEX) -> DataFrame:
    """rules has host, path, verdict (``allow`` or ``block``). Returns id_col,
    host, path, rule, verdict: one row for each row of pages.

    Only the label counts and path lengths that occur in rules are expanded, so
    a URL makes at most (label counts x path lengths) rows; both lists are
    bounded by the longest host and path of a rule, not by the data.
    """
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    known = rules.select(F.coalesce("host", F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host != ''")
    known = known.withColumn("rule", F.concat("r_host", "r_path"))
    shapes = known.agg(F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")).first()
    labels, lengths = sorted(shapes["labels"]), sorted(shapes["lengths"])

    distinct = urls.where("host != ''").select("host", "path").distinct()
    parts = F.split("host", r"\.")
    hosts = F.filter(
        F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels] or [F.lit(None).cast("string")]),
        lambda x: x.isNotNull(),
    )
    paths = F.filter(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]),
        lambda x: x.isNotNull(),
    )
    expanded = distinct.withColumn("s", F.explode(hosts)).withColumn("expression", F.explode(F.transform(paths, lambda p: F.concat(F.col("s"), p))))
    near = _hashed(expanded, "expression", prefix_hex).join(buckets(known, prefix_hex), "prefix")
    hits = near.withColumn("hit", F.explode(F.filter("bucket", lambda r: r["digest"] == F.col("digest")))).select("host", "path", "hit.*")
    rank = F.struct(F.length("rule"), F.length("r_host"), F.col("r_verdict") == "block", F.col("rule"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "r_verdict"), rank).alias("best"))
    named = urls.where("host != ''").join(best, ["host", "path"], "left").select("id", "host", "path", "best")
    rest = urls.where("host = ''").select("id", "host", "path", F.lit(None).cast(best.schema["best"].dataType).alias("best"))
    return named.unionByName(rest).select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
