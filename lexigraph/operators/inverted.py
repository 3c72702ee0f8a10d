"""An inverted index on disk that a search reads a little of.

Postings are packed into blocks: of one word in one field, the documents of one
interval (documents are dealt to intervals of about DOCS by a hash of their ids, the
same for all words). A block knows the largest score its word gives in it, but for
what is the same in all of the word's blocks and kept by the word. Blocks
are sorted by word over ranges, so a word is in few files and few row groups, and one
row for each file says which words it has from and to. A search opens the files of
its words alone and filters them by the words themselves, which Parquet answers from
its statistics.

A query's k best are found in two steps. From the blocks' heads (no postings): in an
interval a document scores at most the sum of its words' largest, and some document
at least the largest of them; so the k-th best interval's least is a floor, and
intervals whose most is below the floor hold nothing of the k best. Only the rest is
unpacked and scored. That is exact, whatever is skipped.

Words with very many documents have as many blocks as intervals, in as many files as
they fill: no file or task holds a word. What comes to the driver is a row for each
file that has a query's words.
"""

from __future__ import annotations

import atexit
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import BadRequest
from ..functions import counting
from ..storage import drop, forget, materialise, shared_dir
from . import lexical
from .ranking import top_k

#: Documents of an interval; blocks of a file; words that one search may ask for.
DOCS, FILE_BLOCKS, FILE_ROWS, MOST_WORDS = 64, 50_000, 20_000, 5_000
#: Rows about files that are kept on the driver; beyond that they are looked up.
HELD = 4_096
#: Sums are made in another order than bounds: what a bound may fall short by.
SLACK = 1e-9
ROW_GROUP, PAGE = 1 << 19, 1 << 14


@dataclass(frozen=True)
class Sorted:
    """A table sorted by a column over files; files: path, low, high."""

    spark: SparkSession
    schema: StructType
    by: str
    files: DataFrame
    held: tuple | None  # the rows of files, where they are no more than HELD

    def read(self, values: list) -> DataFrame:
        """The rows of values, from the files that may have them."""
        values = sorted(set(values))
        if len(values) > MOST_WORDS:
            raise BadRequest(f"{len(values)} keys at once", {"most": MOST_WORDS}, "ask in smaller batches")
        paths = []
        if values:
            near = self.held if self.held is not None else self.files.where((F.col("high") >= values[0]) & (F.col("low") <= values[-1])).collect()
            paths = sorted(path for path, low, high in near if (i := bisect_left(values, low)) < len(values) and values[i] <= high)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).where(F.col(self.by).isin(values))


def write_sorted(df: DataFrame, by: str, *then: str, name: str = "sorted", rows: int = FILE_ROWS) -> Sorted:
    """Writes df (a table, not a plan of much work: it is read twice) sorted by a
    column and then others, about so many rows a file."""
    parts = max(1, -(-df.count() // rows))
    return _written(df.where(F.col(by).isNotNull()).repartitionByRange(parts, by, *then).sortWithinPartitions(by, *then), by, name, parts)


def _written(df: DataFrame, by: str, name: str, parts: int) -> Sorted:
    """Writes df, which is sorted over so many partitions."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexigraph-{name}-{uuid.uuid4().hex}"
    df.write.options(**{"parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE}).parquet(path)
    atexit.register(forget, spark, path)
    files = spark.read.schema(df.schema).parquet(path).select(F.col("_metadata.file_path").alias("path"), by).groupBy("path").agg(F.min(by).alias("low"), F.max(by).alias("high"))
    files = materialise(files, f"{name}-files", parts * 200)
    held = files.limit(HELD + 1).collect()
    return Sorted(spark, df.schema, by, files, tuple(map(tuple, held)) if len(held) <= HELD else None)


@dataclass(frozen=True)
class Clustered:
    """blocks: token, field, block, peak (the largest score in it but for the word's
    idf), doc, tf, len (lists), sorted by token; words: token, field, df, sorted by
    token; fields: as in a lexical index."""

    blocks: Sorted
    words: Sorted
    fields: DataFrame

    def read(self, words: list[str]) -> DataFrame:
        """(token, field, block, most, doc, tf, len, df) of words, MOST_WORDS at most."""
        # The words' rows are as many as the fields that have them, the statistics one for each field.
        known = self.words.read(words).join(F.broadcast(self.fields), "field").select("token", "field", "df", lexical.idf(F.col("n"), F.col("df")).alias("idf"))
        return self.blocks.read(words).join(F.broadcast(known), ["token", "field"]).select("token", "field", "block", (F.col("idf") * F.col("peak")).alias("most"), "doc", "tf", "len", "df")

    def postings(self, words: list[str]) -> DataFrame:
        """(field, token, doc, tf, len, df) of words: a lexical index's postings."""
        zipped = F.explode(F.arrays_zip("doc", "tf", "len")).alias("p")
        return self.read(words).select("field", "token", zipped, "df").select("field", "token", "p.doc", "p.tf", "p.len", "df")


def _scored():
    return lexical.bm25(F.col("tf"), F.col("len"), F.col("avg_len"), F.col("n"), F.col("df"))


#: Postings that a task packs at once; documents whose postings of a word one task sorts.
PACKED, GROUP = 1 << 19, 250_000


def _lists(starts: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), values)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    n = len(columns[0])
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))) if n else np.zeros(0, np.int64)


def _packed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Postings as they come, a row for each word, field and group of intervals."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        token, field = (pc.dictionary_encode(t[c].combine_chunks()) for c in ("token", "field"))
        key = token.indices.to_numpy().astype(np.int64) * len(field.dictionary) + field.indices.to_numpy()
        block = t["block"].combine_chunks().to_numpy()
        order = np.lexsort((block, key))
        first = _changes(key[order], block[order] // width)
        at = pa.array(order)
        names = ["block", "doc", "tf", "len"]
        ps = pa.StructArray.from_arrays([t[c].combine_chunks().take(at) for c in names], names)
        one = pa.array(order[first])
        return pa.RecordBatch.from_arrays([t["token"].combine_chunks().take(one), t["field"].combine_chunks().take(one), pa.array(block[order[first]] // width), _lists(first, len(order), ps)], ["token", "field", "grp", "ps"])

    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= PACKED:
            yield pack(held)
            held, n = [], 0
    if n:
        yield pack(held)


def _blocks(batches: Iterator[pa.RecordBatch], lengths: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that _packed gave, sorted by word, field and group."""

    def make(rows: pa.Table, run: np.ndarray) -> pa.RecordBatch:
        ps, first = rows["ps"].combine_chunks(), _changes(run)
        of, ps = np.repeat(run, ps.value_lengths().to_numpy()), ps.flatten()
        block, doc = ps.field("block").to_numpy(), ps.field("doc")
        place = np.empty(len(doc), np.int64)
        place[pc.sort_indices(doc).to_numpy()] = np.arange(len(doc))
        order = np.lexsort((place, block, of))
        at = pa.array(order)
        doc, tf, length = (ps.field(c).take(at) for c in ("doc", "tf", "len"))
        starts = _changes(of[order], block[order])
        row = pa.array(first[of[order][starts]])
        names = rows["field"].combine_chunks().take(pa.array(first))
        usual = np.array([lengths[f] for f in names.to_pylist()])[of[order]]
        score = tf.to_numpy() * (lexical.K1 + 1) / (tf.to_numpy() + lexical.K1 * (1 - lexical.B + lexical.B * length.to_numpy() / usual))
        columns = [rows["token"].combine_chunks().take(row), rows["field"].combine_chunks().take(row), pa.array(block[order][starts]), pa.array(np.maximum.reduceat(score, starts))]
        return pa.RecordBatch.from_arrays([*columns, *[_lists(starts, len(order), x) for x in (doc, tf, length)]], ["token", "field", "block", "peak", "doc", "tf", "len"])

    held = None
    for b in (p for x in batches for p in counting.pieces(x, "ps", PACKED)):
        rows = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
        runs = [pc.dictionary_encode(rows[c].combine_chunks()).indices.to_numpy() for c in ("token", "field", "grp")]
        first = _changes(*runs)
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, rows.num_rows)))
        # The last word may go on.
        if len(first) > 1:
            yield make(rows.slice(0, first[-1]), run[: first[-1]])
        held = rows.slice(first[-1])
    if held is not None and held.num_rows:
        yield make(held, np.zeros(held.num_rows, np.int64))


def write(index: lexical.LexicalIndex, name: str = "clustered") -> Clustered:
    """Writes an index's postings as blocks sorted by word. Postings are packed where
    texts lie, so that a word is moved once for all its documents of a piece, and moved
    once, in order; what a word's documents come to is kept by the word."""
    source = index.postings if index.counts is None else index.counts
    types = dict(source.dtypes)
    fields = materialise(index.fields, f"{name}-fields")
    lengths = {r["field"]: r["avg_len"] for r in fields.collect()}  # a row for each field of the schema
    n = fields.agg(F.max("n").alias("n")).first()["n"] or 0
    intervals = max(1, -(-n // DOCS))
    width = -(-intervals // max(1, -(-n // GROUP)))
    rows = source.where("token is not null").select("token", "field", F.pmod(F.xxhash64("doc"), F.lit(intervals)).alias("block"), "doc", "tf", "len")
    packed = rows.mapInArrow(lambda batches: _packed(batches, width), f"token string, field string, grp bigint, ps array<struct<block:bigint,doc:{types['doc']},tf:{types['tf']},len:{types['len']}>>")
    packed = materialise(packed, f"{name}-packed")
    words = materialise(packed.groupBy("token", "field").agg(F.sum(F.size("ps")).alias("df")), f"{name}-words")
    blocks = words.agg(F.sum(F.least("df", F.lit(intervals))).alias("n")).first()["n"] or 0  # at most
    parts = max(1, -(-blocks // FILE_BLOCKS))
    keys = ["token", "field", "grp"]
    made = packed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: _blocks(batches, lengths), f"token string, field string, block bigint, peak double, doc array<{types['doc']}>, tf array<{types['tf']}>, len array<{types['len']}>")
    made = _written(made, "token", f"{name}-sorted", parts)
    by_word = write_sorted(words, "token", name=f"{name}-by-word")
    for done in (packed, words):
        drop(done)
    return Clustered(made, by_word, fields)


def search(queries: DataFrame, index: Clustered, boosts: dict[str, float], k: int, stop: bool = True) -> DataFrame:
    """(qid, doc, score, rank): each query's k best documents over the boosted
    fields, as lexical.search finds them. For batches whose words can be listed."""
    wanted = lexical.query_tokens(queries, stop).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("times")).limit(MOST_WORDS * MOST_WORDS).collect()
    return search_words([tuple(r) for r in wanted], index, boosts, k)


def search_words(wanted: list[tuple], index: Clustered, boosts: dict[str, float], k: int) -> DataFrame:
    """The same for words (qid, token, times) that a query may ask for several times."""
    spark = index.blocks.spark
    mine, boost = _boosted(index, [w for _, w, _ in wanted], boosts)
    wanted = pa.table({c: pa.array([w[i] for w in wanted], t) for i, (c, t) in enumerate((("qid", pa.string()), ("token", pa.string()), ("times", pa.int64())))})
    wanted = F.broadcast(spark.createDataFrame(wanted).coalesce(1))
    heads = mine.select("token", "block", (boost * F.col("most")).alias("most")).join(wanted, "token")
    # A document has a word in several fields or in one: at least the largest field's share, at most all fields'.
    by_interval = heads.groupBy("qid", "block").agg(F.sum(F.col("most") * F.col("times")).alias("most"), F.max("most").alias("least"))
    kept = by_interval.join(floors(by_interval, k), "qid", "left").where(KEPT).select("qid", "block")
    unpacked = mine.join(kept.select("block").distinct(), "block", "left_semi").select("token", "field", "block", F.explode(F.arrays_zip("doc", "tf", "len")).alias("p"), "df").select("token", "field", "block", "p.*", "df")
    by_word = unpacked.join(F.broadcast(index.fields), "field").groupBy("token", "block", "doc").agg(F.sum(boost * _scored()).alias("part"))
    sums = by_word.join(wanted, "token").join(kept, ["qid", "block"], "left_semi").groupBy("qid", "doc").agg(F.sum(F.col("part") * F.col("times")).alias("score"))
    return top_k(sums, "qid", "score", "doc", k)


#: Whether an interval may hold one of the k best.
KEPT = f"floor IS NULL OR most * (1 + {SLACK}) >= floor"


def _boosted(index: Clustered, words: list[str], boosts: dict[str, float]):
    used = {f: float(b) for f, b in boosts.items() if b}
    boost = F.element_at(F.create_map(*[F.lit(x) for f, b in used.items() for x in (f, b)]), F.col("field"))
    return index.read(words).where(F.col("field").isin(*used)), boost


def floors(by_interval: DataFrame, k: int) -> DataFrame:
    """(qid, floor): what the k-th best document scores at least; queries that
    fewer than k intervals have a word of have none."""
    w = W.partitionBy("qid").orderBy(F.col("least").desc(), "block")
    return by_interval.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).where(F.col("k") == k).select("qid", F.col("least").alias("floor"))


def kept_intervals(queries: DataFrame, index: Clustered, boosts: dict[str, float], k: int) -> DataFrame:
    """(qid, intervals, kept): how many intervals have a query's words, and how
    many of them had to be scored."""
    wanted = lexical.query_tokens(queries).select("qid", "token").distinct()
    mine, boost = _boosted(index, [r[0] for r in wanted.select("token").distinct().limit(MOST_WORDS + 1).collect()], boosts)
    heads = mine.select("token", "block", (boost * F.col("most")).alias("most")).join(F.broadcast(wanted), "token")
    by = heads.groupBy("qid", "block").agg(F.sum("most").alias("most"), F.max("most").alias("least"))
    return by.join(floors(by, k), "qid", "left").groupBy("qid").agg(F.count(F.lit(1)).alias("intervals"), F.count_if(F.expr(KEPT)).alias("kept"))
