"""Katz backoff of any order, as tables joined by key.

    P(w | h) = d(c) c(h w) / c(h)      if h w was counted
             = alpha(h) P(w | h')      else; h' is h without its first word
    P(w)     = d(c) c(w) / N           for known words; the rest is the unknown's

Every level is a table (context, lower context, word, count) dealt by context, and
one of contexts with their alpha; d are Good-Turing discounts of each level's
counts of counts, and alpha(h) = (1 - what h's words have) / (1 - what the same
words have one level down) makes each distribution sum to one exactly. An n-gram
is evaluated from the lowest level up, each level one equi-join, for all n-grams of
all texts at once; each distinct n-gram and each distinct text is looked at once.

DataFrame functions only. ``katz`` scores with bigrams in packed arrays at a tenth
of the shuffle; this form has no such limit of order.

Defined results: as in ``katz``: a null text is an empty one, scored by its end;
without training rows every token is unknown and scores 0; a null id trains; equal
texts have equal scores, a row each. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise
from .katz import END, GT_MAX, START, good_turing, training_row

BLANKS = r"[\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased words, and the end."""
    words = F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BLANKS), lambda w: w != "")
    return F.concat(F.transform(words, lambda w: F.xxhash64(w)), F.array(F.lit(END).cast("long")))


def ngrams(rows: DataFrame, order: int, *kept: str) -> DataFrame:
    """A row for each token w of (kept..., text), with k1 ... the keys of its contexts
    of 0, 1, ... order - 1 words; before a text's first word stand START marks."""
    start = F.array_repeat(F.lit(START).cast("long"), order - 1)
    padded = rows.select(*kept, F.concat(start, tokens(F.col("text"))).alias("t")).select(*kept, "t", (F.size("t") - (order - 1)).alias("n"))
    side_by_side = F.arrays_zip(*[F.slice("t", F.lit(order - i), F.col("n")).alias(f"p{i}") for i in range(order)])
    each = padded.select(*kept, side_by_side.alias("z")).select(*kept, F.explode("z").alias("z"))
    keys = [F.lit(0).cast("long").alias("k1"), *[F.xxhash64(*[F.col(f"z.p{i}") for i in range(n - 1, 0, -1)]).alias(f"k{n}") for n in range(2, order + 1)]]
    return each.select(*kept, F.col("z.p0").alias("w"), *keys)


def _discounted(c: Column, discounts: dict[int, float]) -> Column:
    d = F.lit(1.0)
    for r, x in discounts.items():
        d = F.when(c == r, float(x)).otherwise(d)
    return d * c


class KatzTables:
    """levels[n]: (k, low, w, c, p) of the n-grams, p their probability; contexts[n]:
    (k, alpha); n, v: tokens and distinct words; unknown: the unknown word's share."""

    def __init__(self, grams: DataFrame, order: int, most: int = GT_MAX):
        """grams: ngrams of the training texts, with m: how many rows have the text."""
        self.order, self.levels, self.contexts = order, {}, {}
        counts = {}
        upper = grams.select(*[f"k{n}" for n in range(1, order + 1)], "w", F.col("m").alias("c"))
        for n in range(order, 0, -1):  # a level's counts are sums of the one above
            keys = [f"k{i}" for i in range(1, n + 1)]
            upper = counts[n] = materialise(upper.groupBy(*keys, "w").agg(F.sum("c").alias("c")), f"katz-counts-{n}")
        for n in range(1, order + 1):
            seen = {r["c"]: r["n"] for r in counts[n].where(F.col("c") <= most + 1).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
            d = good_turing(seen, most)
            rows = counts[n].withColumn("dc", _discounted(F.col("c"), d))
            if n == 1:
                first = rows.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.col("c") - F.col("dc"))).first()
                self.n, self.v = int(first[0] or 0), int(first[1])
                freed = (first[2] or 0.0) / self.n if self.n else 1.0
                self.unknown = freed or 0.5 / (self.n + 0.5)
                scale = (1 - self.unknown) / (1 - freed) if self.n else 1.0
                self.levels[1] = rows.select(F.col("k1").alias("k"), F.lit(0).cast("long").alias("low"), "w", "c", (F.col("dc") * scale / max(self.n, 1)).alias("p"))
                continue
            below = self.levels[n - 1].select(F.col("k").alias("low"), "w", F.col("p").alias("p_low"))
            joined = materialise(rows.select(F.col(f"k{n}").alias("k"), F.col(f"k{n - 1}").alias("low"), "w", "c", "dc").join(below, ["low", "w"]), f"katz-level-{n}")
            sums = joined.groupBy("k").agg(F.sum("c").alias("total"), F.sum("dc").alias("mass"), F.sum("p_low").alias("covered"))
            over = F.when(F.col("mass") > F.col("total") - 1e-6, F.col("total") + 0.5).otherwise(F.col("total"))
            alpha = (1 - F.col("mass") / F.col("over")) / (1 - F.col("covered"))
            self.contexts[n] = materialise(sums.withColumn("over", over).select("k", "over", alpha.alias("alpha")), f"katz-contexts-{n}")
            self.levels[n] = joined.join(self.contexts[n].select("k", "over"), "k").select("k", "low", "w", "c", (F.col("dc") / F.col("over")).alias("p"))
            if n < order:
                self.levels[n] = materialise(self.levels[n], f"katz-p-{n}")

    def evaluate(self, grams: DataFrame) -> DataFrame:
        """Distinct grams (k1 ... w) with c, their word's count, and logp."""
        one = self.levels[1].select("w", "c", F.log10("p").alias("logp"))
        out = grams.join(one, "w", "left").withColumn("logp", F.coalesce("logp", F.log10(F.lit(self.unknown)))).withColumn("c", F.coalesce("c", F.lit(0)))
        for n in range(2, self.order + 1):
            found = self.levels[n].select(F.col("k").alias(f"k{n}"), "w", F.log10("p").alias("found"))
            back = self.contexts[n].select(F.col("k").alias(f"k{n}"), F.log10("alpha").alias("back"))
            out = out.join(found, [f"k{n}", "w"], "left").join(back, f"k{n}", "left")
            # Backed off where the n-gram wasn't counted; an unseen context takes nothing off.
            out = out.withColumn("logp", F.coalesce("found", F.coalesce("back", F.lit(0.0)) + F.col("logp"))).drop("found", "back")
        return out


def score_by_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, most: int = GT_MAX) -> DataFrame:
    """Learns n-grams up to order from the training rows of docs and scores all.
    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), training_row(F.col(id_col)).alias("train"), text.alias("text"), *key)
    texts = materialise(rows.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.sum(F.col("train").cast("long")).alias("m")), "katz-texts")
    model = KatzTables(ngrams(texts.where("m > 0"), order, "m"), order, most)
    keys = [f"k{n}" for n in range(1, order + 1)]
    used = materialise(ngrams(texts, order, "h1", "h2").groupBy("h1", "h2", *keys, "w").agg(F.count(F.lit(1)).alias("times")), "katz-used")
    known = model.evaluate(used.select(*keys, "w").distinct()).select(f"k{order}", "w", "c", "logp")
    base = F.log10((F.col("c") + 0.1) / (model.n + 0.1 * (model.v + 1)))
    total = lambda c: F.sum(F.col("times") * c)
    scores = used.join(known, [f"k{order}", "w"]).groupBy("h1", "h2").agg(F.sum("times").alias("n_tokens"), total((F.col("c") > 0).cast("long")).alias("n_known"), total(base).alias("base_score"), total(F.col("logp")).alias("score"))
    return rows.join(scores, ["h1", "h2"]).select(F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
