"""Language identification by multilingual mixture inference.

A text is a mixture of languages: each of its byte trigrams comes from language
l with probability pi_l. Expectation-maximisation estimates the proportions over
a set of languages; the set grows from the single best language by the one that
raises the penalised log-likelihood most, until none raises it. The language
with the largest proportion is the prediction.

The trigram tables are fitted on a bounded sample of labelled training rows, at
most ``SAMPLE`` for each language, those with the least hashes of their ids and
texts; all else covers all rows and whole texts. The model has at most
MAX_LANGUAGES x 2**BITS entries, whatever the corpus's size. No task holds a
language: rows are counted by language and hash bucket, and only the bucket in
which a language's sample ends is put in order.

Of more than MAX_LANGUAGES languages those with the most training rows are learned,
ties by name. Texts of equal likelihood get the language whose name comes first.
Very long texts are counted piece by piece; no rows give no rows.

Defined results: a null text or one without a letter is ``und`` with score 0, as
is every text if nothing was learned; repeated rows give repeated rows; a null
id is held in. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, sliced

SAMPLE, MAX_LANGUAGES, BITS = 2_000, 200, 15
#: Hash buckets of each language's rows; bytes of a text that are counted at once.
BUCKETS, PIECE = 4096, 1 << 20
SMOOTH = 0.5
#: Log-likelihood that another language must bring, in units of log(trigrams).
#: A byte takes part in three trigrams, so theirs counts threefold; BIC's half
#: of a unit becomes one and a half.
PENALTY = 1.5
OVERLAP = 3.0
ROUNDS, CLOSE = 40, 1e-4


def gram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """How often each hashed byte trigram of the lower-cased text between blanks
    occurs. A long text is counted piece by piece."""
    whole = np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8)
    out = np.zeros(1 << bits, np.int64)
    for i in range(0, max(1, len(whole) - 2), PIECE):
        b = whole[i : i + PIECE + 2].astype(np.uint32)
        x = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
        out += np.bincount(x * np.uint32(2654435761) >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    counts: np.ndarray  # languages x 2**bits

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        p = (self.counts + SMOOTH) / (self.counts.sum(axis=1, keepdims=True) + SMOOTH * self.counts.shape[1])
        p = np.ascontiguousarray(p.T)
        return p, np.log(p)


def _em(q: np.ndarray, c: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of a mixture; q: trigrams x languages."""
    n = c.sum()
    for _ in range(ROUNDS):
        mixed = q @ pi
        new = pi * (q.T @ (c / mixed)) / n
        done, pi = np.abs(new - pi).max() < CLOSE, new
        if done:
            break
    return pi, float(c @ np.log(q @ pi))


def infer(text: str, p: np.ndarray, logp: np.ndarray) -> tuple[list[int], np.ndarray, float]:
    """The languages, their proportions, and the first one's posterior among
    all as the only language."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    c, q = counts[at].astype(np.float64), p[at]
    alone = c @ logp[at]
    best = int(alone.argmax())
    posterior = float(1 / np.exp((alone - alone[best]) / OVERLAP).sum())
    chosen, pi, ll = [best], np.ones(1), float(alone[best])
    n = c.sum()
    price = PENALTY * np.log(n)
    while len(chosen) < p.shape[1]:
        ratio = (c / (q[:, chosen] @ pi)) @ q / n
        found = None
        for other in np.flatnonzero(n * np.log(np.maximum(ratio, 1e-300)) > price):
            # By concavity no mixture gains more than n log(mean ratio), so the rest can't pay.
            if other not in chosen:
                new, gain = _em(q[:, [*chosen, other]], c, np.append(pi * 0.9, 0.1))
                if gain - ll > price and (found is None or gain > found[2]):
                    found = ([*chosen, int(other)], new, gain)
        if found is None:
            break
        chosen, pi, ll = found
    return chosen, pi, posterior


def training_row(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for b in sliced(batches):
        for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
            seen = gram_counts(text)
            totals[lang] = totals[lang] + seen if lang in totals else seen
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "gram", "n"])


def sampled(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Of rows (id, lang, text): each language's first ones in the order of a
    hash of the id, then of the text; exactly sample of them, or all there are."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(BUCKETS)).cast("int")).withColumn("h", F.xxhash64("id", F.lit("order"))).withColumn("t", F.xxhash64("text"))
    counts = rows.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most BUCKETS rows a language, of its sums alone.
    before = F.coalesce(F.sum("n").over(W.partitionBy("lang").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # MAX_LANGUAGES rows: the model's size is theirs, not that of the labels.
    named = counts.groupBy("lang").agg(F.sum("n").alias("rows")).orderBy(F.col("rows").desc(), "lang").limit(MAX_LANGUAGES).select("lang")
    found = counts.withColumn("room", F.lit(sample) - before).where("room > 0").select("lang", "bucket", "n", "room").join(F.broadcast(named), "lang", "left_semi").collect()
    # One row a language: its last bucket, and how many rows of that one there is room for.
    last: dict[str, tuple[int, int, bool]] = {}
    for r in found:
        if r["lang"] not in last or r["bucket"] > last[r["lang"]][0]:
            last[r["lang"]] = (r["bucket"], r["room"], r["n"] > r["room"])
    limits = rows.sparkSession.createDataFrame([(k, *v) for k, v in last.items()], "lang string, last int, room long, crowded boolean")
    chosen = rows.join(F.broadcast(limits), "lang").where("bucket <= last")
    # The window's limit is pushed below its exchange: a task passes on `sample` rows of a bucket at most.
    cut = chosen.where("bucket = last and crowded").withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "t"))).where(F.col("k") <= sample).where("k <= room")
    return chosen.where("bucket < last or not crowded").select("lang", "h", "t", "text").unionByName(cut.select("lang", "h", "t", "text"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(training_row(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # A bounded sample, spread by its hashes: no task has more of a language than of another.
    spread = sampled(rows, sample).repartition("h", "t").select("lang", "text")
    sums = spread.mapInArrow(lean(_count), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # at most MAX_LANGUAGES x 2**BITS rows
    names = sorted(set(found["lang"].to_pylist()))
    place = {x: i for i, x in enumerate(names)}
    counts = np.zeros((len(names), 1 << BITS))
    counts[np.fromiter(map(place.__getitem__, found["lang"].to_pylist()), np.int64, found.num_rows), found["gram"].to_numpy()] = found["n"].to_numpy()
    return Model(tuple(names), counts)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, logp = model.tables()
        for b in sliced(batches):
            out = []
            for text in b["text"].to_pylist():
                if not model.languages or not has_letter(text):
                    out.append(("und", 0.0, 0.0, []))
                    continue
                chosen, pi, posterior = infer(text, p, logp)
                top = int(pi.argmax())
                share = float(min(1.0, pi[top]))
                mixture = sorted(((float(x), model.languages[i]) for i, x in zip(chosen, pi, strict=True)), reverse=True)
                out.append((model.languages[chosen[top]], share * posterior, share, [name for _, name in mixture]))
            lang, score, share, names = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64()), pa.array(names, pa.list_(pa.string()))], ["id", "held_out", "lang_pred", "score", "share", "languages"]
            )

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, held_out, lang_pred, score (share x posterior), share (of
    the largest language) and languages (of the mixture, largest first)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (~training_row(F.col(id_col))).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(_predict(model)), "id long, held_out boolean, lang_pred string, score double, share double, languages array<string>").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least_share: float = 0.5) -> DataFrame:
    """The rows of docs with all their columns, but for those of no language and
    those in which no language has least_share of the text."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, logp = model.tables()
        for b in sliced(batches):
            keep = [bool(model.languages) and has_letter(t) and infer(t, p, logp)[1].max() >= least_share for t in b.column(names.index(text_col)).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), schema)
