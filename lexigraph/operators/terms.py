"""Keywords and phrases of notes: candidates, scores, vocabulary.

Statistics are DataFrame aggregates keyed by note and word; only folds that
depend on their own earlier choices (nested phrases, diversity) and tagging are
Python, one note at a time in Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import NotFound
from ..functions import counting
from ..functions import text as T
from ..storage import materialise
from . import gazetteer as gazetteer_search
from .ranking import max_normalised, reciprocal_rank_fusion, row_numbers

RRF_K = 60

# ---- corpus statistics ----


def lemma_frequencies(notes: DataFrame) -> DataFrame:
    """(lemma, df): how many notes have a word of that lemma."""
    return _lemma_rows(notes, False).groupBy("lemma").agg(F.sum("n").alias("df"))


def _lemma_rows(notes: DataFrame, named: bool) -> DataFrame:
    """Of each piece of notes: a lemma and n, how many of them have it; named: and
    note_ids, which. As T.tokens and T.singular give it, a word once for each piece."""
    key = dict(notes.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in counting.some_texts(batches, "low"):
            cut = pc.split_pattern_regex(b["low"], "[^a-z0-9_+#.-]+")
            of, words = counting._rows_of(cut), pc.dictionary_encode(cut.flatten())
            lemmas = pc.dictionary_encode(pa.array([(_singular(t[0]) if (t := _tokens(w)) else "") for w in words.dictionary.to_pylist()], pa.string()))
            code = lemmas.indices.to_numpy(zero_copy_only=False)[words.indices.to_numpy(zero_copy_only=False)]
            code, row = np.divmod(np.unique(code.astype(np.int64) * b.num_rows + of), b.num_rows)
            kept = pc.not_equal(lemmas.dictionary, "").to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
            found, first = np.unique(code[kept], return_index=True)
            ends = np.append(first, kept.sum()).astype(np.int32)
            columns = [lemmas.dictionary.take(pa.array(found)), pa.array(np.diff(ends), pa.int64())]
            if named:
                columns.append(pa.ListArray.from_arrays(pa.array(ends), b["id"].take(pa.array(row[kept]))))
            yield pa.RecordBatch.from_arrays(columns, ["lemma", "n", "note_ids"][: len(columns)])

    low = notes.select("id", F.coalesce(F.lower("body"), F.lit("")).alias("low"))
    return low.mapInArrow(run, "lemma string, n bigint" + (f", note_ids array<{key}>" if named else ""))


def smoothed_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (F.greatest(F.lit(1), F.coalesce(df, F.lit(0))) + 0.5))


def word_stats(notes: DataFrame, spread: bool = False) -> DataFrame:
    """Of each note's words: tf, capitalised (not first in a sentence), acronyms,
    sentences, middle (its middle sentence), neighbours left and right, distinct
    and in all, and n_sentences of the note. With spread also what tf_spread says.

    A note is counted within its row, as its text is there already; words aren't
    moved, and a task holds some hundred notes at once.
    """
    return counting.word_numbers(_sentences(notes), "note_id", (*counting.NUMBERS, *(counting.SPREAD if spread else ())))


def note_spread(notes: DataFrame) -> DataFrame:
    """(note_id, mean, dev, most) of tf_spread, a row for each note with words."""
    return counting.word_numbers(_sentences(notes), "note_id", counting.SPREAD, by_note=True)


def _sentences(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("id").alias("note_id"), T.sentences(F.col("body")).alias("ss"))


def tf_spread() -> tuple[Column, Column, Column]:
    """Mean, population deviation and greatest of a note's word frequencies, stop
    words left out: 1, 0 and 1 for a note of nothing else."""
    w = W.partitionBy("note_id")
    tf = F.when(~F.col("word").isin(*T.STOP_WORDS), F.col("tf"))
    return F.coalesce(F.avg(tf).over(w), F.lit(1.0)), F.coalesce(F.stddev_pop(tf).over(w), F.lit(0.0)), F.greatest(F.coalesce(F.max(tf).over(w), F.lit(1)), F.lit(1))


def yake(stats: DataFrame) -> DataFrame:
    """(note_id, word, tf, cost): low costs make good keywords. The spread of a
    note's frequencies is read from stats where they have it."""
    mean, dev, most = map(F.col, counting.SPREAD) if set(counting.SPREAD) <= set(stats.columns) else tf_spread()
    casing = F.greatest("capitalised", "acronyms") / (1 + F.log(F.col("tf").cast("double")))
    position = F.log(F.log(3.0 + F.col("middle")))
    frequency = F.col("tf") / F.greatest(F.lit(1e-9), mean + dev)
    spread = F.col("sentences") / F.greatest(F.lit(1), F.col("n_sentences"))
    sides = F.col("left_kinds") / F.greatest(F.lit(1), F.col("left_all")) + F.col("right_kinds") / F.greatest(F.lit(1), F.col("right_all"))
    rel = 1 + sides * (F.col("tf") / most)
    cost = rel * position / F.greatest(F.lit(1e-9), casing + frequency / rel + spread / rel)
    return stats.select("note_id", "word", "tf", cost.alias("cost"))


def phrase_costs(candidates: DataFrame, costs: DataFrame) -> DataFrame:
    """candidates (note_id, lemma, text, occurrences, ...) with yake = 1 / (1 +
    cost): the product of the words' costs over occurrences x (1 + their sum).
    Words without a cost count 1."""
    words = candidates.select("note_id", "lemma", F.posexplode(T.tokens(F.col("text"))).alias("at", "word"))
    known = words.join(costs.select("note_id", "word", "cost"), ["note_id", "word"], "left").withColumn("cost", F.coalesce("cost", F.lit(1.0)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "cost"))), lambda x: x["cost"])
    sums = known.groupBy("note_id", "lemma").agg(ordered.alias("costs"))
    product = F.aggregate("costs", F.lit(1.0), lambda a, x: a * x)
    total = F.aggregate("costs", F.lit(0.0), lambda a, x: a + x)
    cost = product / (F.greatest(F.lit(1), F.col("occurrences")) * (1 + total))
    both = candidates.join(sums, ["note_id", "lemma"], "left")
    return both.select(*candidates.columns, inverted(F.when(F.col("costs").isNotNull(), cost)).alias("yake"))


# ---- candidates ----

#: Endings by which words that no list knows are told apart.
_ADJECTIVE = re.compile(r"(?:able|ible|al|ic|ous|ive|ful|less|ary|ish)$")
_PARTICIPLE = re.compile(r"(?:[^e]ed|ized|ated)$")
_VERB = re.compile(r"(?:ize|ise|ify|ates?|izes?|ises?)$")
_ADVERB = re.compile(r"ly$")
_GERUND = re.compile(r"ing$")
#: Frequent verbs whose form is a noun's too; after a noun or pronoun they are verbs.
_BARE_VERBS = frozenset("is are was were be been being has have had do does did run runs make makes take takes use uses need needs keep keeps hold holds give gives get gets go goes come comes see sees know knows let lets write writes read reads say says mean".split())
_TOKEN = re.compile(r"[A-Za-z0-9_+#][A-Za-z0-9_+#.'-]*|[^\sA-Za-z0-9]")


_STOP = frozenset(T.STOP_WORDS)


@lru_cache(maxsize=100_000)
def word_class(word: str) -> str:
    """What a word may be by itself: x nothing, P participle, J adjective, G a noun
    or gerund, W a noun or verb, B either of the last two, N noun."""
    low = word.lower().rstrip(".")
    if not re.search("[A-Za-z]", word) or low in _STOP or _ADVERB.search(low) or low in _BARE_VERBS:
        return "x"
    if len(low) > 4 and _PARTICIPLE.search(low):
        return "P"
    if len(low) > 4 and _ADJECTIVE.search(low):
        return "J"
    if len(low) <= 5:
        return "N"
    gerund, verb = bool(_GERUND.search(low)), bool(_VERB.search(low))
    return "B" if gerund and verb else "G" if gerund else "W" if verb else "N"


@lru_cache(maxsize=100_000)
def _modified(word: str) -> bool:
    """Whether a participle before this word may modify it."""
    low = word.lower()
    return bool(low) and low not in _STOP and "a" <= low[0] <= "z"


def _tagged(code: np.ndarray, words: list[tuple]) -> np.ndarray:
    """A letter for each token: N noun, J adjective, V participle as modifier, x
    anything else. A small tagger by endings and neighbours. code: of each token its
    place in words; the first and each sentence's last token are nothing ("")."""
    kind = np.frombuffer("".join(w[0] for w in words).encode(), np.uint8)[code]
    modified = np.array([w[1] for w in words], bool)[code]
    x, P, V, N, J, G, W, B = b"xPVNJGWB"  # noqa: N806
    at = np.flatnonzero(kind == P)
    kind[at] = np.where(modified[at + 1], V, x)
    left = np.flatnonzero((kind == G) | (kind == W) | (kind == B))
    while len(left):  # each by the one before it, as soon as that one is known
        before, mine = kind[left - 1], kind[left]
        known = ~np.isin(before, (G, W, B))
        none = (mine != W) & (before != N) & (before != J) | (mine != G) & (before == N)
        kind[left[known]] = np.where(none, x, N)[known]
        left = left[~known]
    return kind


@lru_cache(maxsize=100_000)
def _lemma(text: str) -> str:
    words = [re.sub(r"^[.\-_]+|[.\-_]+$", "", w) for w in re.split(r"[^a-z0-9_+#.-]+", text.lower())]
    return " ".join(_singular(w) for w in words if len(w) > 1 and re.search("[a-z]", w))


@lru_cache(maxsize=100_000)
def _singular(w: str) -> str:
    if len(w) < T.SHORTEST or re.search(T.NO_PLURAL, w):
        return w
    return next((w[:-gone] + instead for ending, gone, instead in T.PLURALS if re.search(ending, w)), w)


@lru_cache(maxsize=100_000)
def _word(token: str) -> tuple[str, bool, str, str, tuple[str, ...], tuple[str, ...]]:
    """Of a token: its class, whether a participle may modify it, as it reads, its
    lemma, and the words that these two have."""
    bare = token.rstrip(".'")
    lemma = _lemma(bare)
    return word_class(token), _modified(token), bare, lemma, _tokens(bare), _tokens(lemma)


def _joined(words: pa.Array, starts: np.ndarray, length: int) -> pa.Array:
    """Of so many tokens from each start those that aren't empty, with blanks between."""
    each = pc.binary_join_element_wise(*[words.take(pa.array(starts + j)) for j in range(length)], " ")
    return pc.ascii_trim_whitespace(pc.replace_substring_regex(each, " {2,}", " "))


def noun_phrases(sentences: pa.Array, most: int = 4) -> tuple[np.ndarray, dict[str, pa.Array], list[tuple], np.ndarray]:
    """Of notes (lists of sentences) the runs of modifiers and nouns that end in a noun:
    the run, its head, and of longer runs the last two words; each lemma of a note
    once, in the order of its first. Returns the note's row of each, its columns, the
    words that tokens are, and of each the places of its words (-1: none) in these."""
    flat, tokens, ends = sentences.flatten().to_pylist(), [""], []
    for s in flat:
        tokens += _TOKEN.findall(s or "")
        tokens.append("")
        ends.append(len(tokens))
    coded = pc.dictionary_encode(pa.array(tokens, pa.string()))
    code, words = coded.indices.to_numpy(zero_copy_only=False), [_word(w) for w in coded.dictionary.to_pylist()]
    note_of, n_sentences = counting._rows_of(sentences), pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False)
    start = np.cumsum(n_sentences) - n_sentences
    kind = _tagged(code, words)
    inside = kind != ord("x")
    begin, last = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:])
    end = np.maximum.accumulate(np.where(kind == ord("N"), np.arange(len(kind)), 0))[last] + 1
    begin, end = begin[end > begin], end[end > begin]
    begin = np.maximum(begin, end - most)
    size, run = end - begin, np.arange(len(begin))
    # Spans in the order of their runs: the run, its head, its last two words.
    spans = [(run, begin, size), (run[size > 1], end[size > 1] - 1, np.ones((size > 1).sum(), np.int64)), (run[size > 2], end[size > 2] - 2, np.full((size > 2).sum(), 2))]
    order = np.argsort(np.concatenate([r * 3 + k for k, (r, _, _) in enumerate(spans)]))
    first, length = (np.concatenate([x[i] for x in spans])[order] for i in (1, 2))
    whole = np.arange(len(first))
    surface = lemma = pa.array([], pa.string())
    read, plain = (pa.array([w[i] for w in words], pa.string()).take(pa.array(code)) for i in (2, 3))
    parts = [(at := np.flatnonzero(length == k), _joined(read, first[at], k) if k > 1 else plain.take(pa.array(first[at])), _joined(plain, first[at], k)) for k in np.unique(length)]
    if parts:
        back = pa.array(np.argsort(np.concatenate([at for at, _, _ in parts])))
        surface, lemma = (pa.concat_arrays([p[i] for p in parts]).take(back) for i in (1, 2))
    kept = pc.greater(pc.binary_length(lemma), 2)
    whole = whole[kept.to_numpy(zero_copy_only=False)]
    lemma, surface, first, length = lemma.filter(kept), surface.filter(kept), first[whole], length[whole]
    sentence = np.searchsorted(np.array(ends, np.int64), first, "right")
    note = note_of[sentence] if len(first) else np.zeros(0, np.int64)
    sentence = sentence - start[note]
    named = pc.dictionary_encode(lemma)
    by = max(1, len(named.dictionary))
    _, one, group, count = np.unique(note * by + named.indices.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True, return_counts=True)
    width = int(n_sentences.max(initial=0)) + 1
    within = np.bincount(np.unique(group * width + sentence) // width, minlength=len(one))
    order = np.argsort(one)
    one, count, within = one[order], count[order], within[order]
    note, length = note[one], length[one]
    columns = {
        "position": pa.array(np.arange(len(one)) - np.searchsorted(note, note), pa.int32()), "lemma": lemma.take(pa.array(one)), "text": surface.take(pa.array(one)), "kind": pc.if_else(pa.array(length >= 3), "phrase", "keyword"),
        "count": pa.array(count, pa.int32()), "first_sentence": pa.array(sentence[one], pa.int32()), "sentences": pa.array(within, pa.int32()),
    }
    places = np.stack([np.where(j < length, code[np.minimum(first[one] + j, len(code) - 1)], -1) for j in range(most)], axis=1)
    return note, columns, words, places


#: Characters of a text that is searched for each phrase by itself.
SHORT = 3_000


def occurrences(text: str, phrases: list[str]) -> list[int]:
    """How often each phrase occurs in text, overlaps of one with itself left
    out: all phrases of a long text in one pass over it."""
    if len(text) <= SHORT:
        return [text.count(p) for p in phrases]
    import ahocorasick

    finder = ahocorasick.Automaton()
    for p in phrases:
        finder.add_word(p, (len(p), p))
    found: dict[str, int] = dict.fromkeys(phrases, 0)
    if len(finder):
        finder.make_automaton()
        free: dict[str, int] = {}
        for end, (length, p) in finder.iter(text):
            if end - length >= free.get(p, -1):
                found[p] += 1
                free[p] = end
    return [found[p] for p in phrases]


#: Bytes of sentences whose candidates are found at once; a note of more by itself.
PIECE = 1 << 20
MADE = "position int, lemma string, text string, kind string, count int, first_sentence int, sentences int, occurrences int"


def _found(b: pa.RecordBatch, most: int) -> tuple[np.ndarray, dict[str, pa.Array], list[tuple], np.ndarray]:
    """As noun_phrases, with how often each candidate reads so in its note."""
    note, columns, words, places = noun_phrases(b["ss"], most)
    low, at = pc.ascii_lower(columns["text"]).to_pylist(), np.searchsorted(note, np.arange(b.num_rows + 1)).tolist()
    times = [n for i, body in enumerate(b["body"].to_pylist()) for n in occurrences((body or "").lower(), low[at[i] : at[i + 1]])]
    return note, {**columns, "occurrences": pa.array(times, pa.int32())}, words, places


def _batch(b: pa.RecordBatch, note: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b["note_id"].take(pa.array(note)), *columns.values()], ["note_id", *columns])


def candidates(notes: DataFrame, most: int = 4) -> DataFrame:
    """Noun phrases of each note, with how often each reads so in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for x in batches for p in counting.pieces(x, "ss", PIECE, pc.binary_length)):
            yield _batch(b, *_found(b, most)[:2])

    cut = notes.select(F.col("id").alias("note_id"), T.sentences(T.strip_fenced(F.col("body"))).alias("ss"), "body")
    return cut.mapInArrow(run, f"note_id {dict(notes.dtypes)['id']}, {MADE}")


@lru_cache(maxsize=100_000)
def _tokens(text: str) -> tuple[str, ...]:
    """As T.tokens."""
    bare = (re.sub(r"^[.\-_]+|[.\-_]+$", "", w) for w in re.split(r"[^a-z0-9_+#.-]+", text.lower()))
    return tuple(w for w in bare if len(w) > 1 and re.search("[a-z]", w))


def _cost(x: dict[str, np.ndarray]) -> np.ndarray:
    """As yake."""
    tf = x["tf"].astype(np.float64)
    casing = np.maximum(x["capitalised"], x["acronyms"]) / (1 + np.log(tf))
    rel = 1 + (x["left_kinds"] / np.maximum(1, x["left_all"]) + x["right_kinds"] / np.maximum(1, x["right_all"])) * (tf / x["most"])
    frequency, spread = tf / np.maximum(1e-9, x["mean"] + x["dev"]), x["sentences"] / np.maximum(1, x["n_sentences"])
    return rel * np.log(np.log(3.0 + x["middle"])) / np.maximum(1e-9, casing + frequency / rel + spread / rel)


def _costed(b: pa.RecordBatch, most: int, stop: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The candidates of a batch's notes with yake, as phrase_costs gives it."""
    note, columns, words, places = _found(b, most)
    of, known, numbers = counting._numbers(b["words"], stop)
    known = pc.dictionary_encode(known)
    size = max(1, len(known.dictionary))
    keys = of * size + known.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(keys)
    keys, cost = np.append(keys[order], -1), np.append(_cost(numbers)[order], 1.0)
    # A word by itself has its lemma's words, one of several those that it reads as.
    texts = [w[4] for w in words] + [w[5] for w in words]
    code = pc.fill_null(pc.index_in(pa.array([t for x in texts for t in x], pa.string()), value_set=known.dictionary), -1).to_numpy(zero_copy_only=False)
    has = np.array([*map(len, texts), 0], np.int64)
    begin = np.cumsum(has) - has
    places = np.where(places < 0, len(texts), places)
    places[:, 0] = np.where((places[:, 1:] == len(texts)).all(axis=1), places[:, 0] + len(words), places[:, 0])
    product, total, any_ = np.ones(len(note)), np.zeros(len(note)), np.zeros(len(note), bool)
    for j in range(places.shape[1]):
        for k in range(int(has.max())):
            at = np.flatnonzero(has[places[:, j]] > k)
            word = code[begin[places[at, j]] + k]
            key = note[at] * size + word
            found = np.searchsorted(keys[:-1], key)
            c = np.where((word >= 0) & (keys[found] == key), cost[found], 1.0)
            product[at], total[at], any_[at] = product[at] * c, total[at] + c, True
    score = 1 / (1 + product / (np.maximum(1, columns["occurrences"].to_numpy()) * (1 + total)))
    return note, {**columns, "yake": pa.array(np.where(any_, score, 0.0))}


def costed_candidates(notes: DataFrame, most: int = 4) -> DataFrame:
    """candidates with yake, as phrase_costs gives it from word_stats: a note's words
    and its phrases meet within its row, and neither is moved."""
    stop = list(T.STOP_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for x in batches for p in counting.pieces(x, "words", PIECE, pc.binary_length)):
            yield _batch(b, *_costed(b, most, pa.array(stop)))

    cut = notes.select(F.col("id").alias("note_id"), *_texts())
    return cut.mapInArrow(run, f"note_id {dict(notes.dtypes)['id']}, {MADE}, yake double")


def _texts() -> list[Column]:
    body = F.col("body")
    return [T.sentences(T.strip_fenced(body)).alias("ss"), T.sentences(body).alias("words"), body]


# ---- scores ----


def structural(candidates: DataFrame, signals: DataFrame) -> DataFrame:
    """candidates with structural, a multiplier: 1, and what the title, headings,
    emphasis, tags and the anchors of links to the note add for the lemma.
    signals: note_id, title, headings, emphasised, tags, anchors (arrays)."""
    s = signals.select(
        "note_id", _signal_keys(F.array("title")).alias("k_title"), _signal_keys(F.col("headings")).alias("k_headings"), _signal_keys(F.col("emphasised")).alias("k_emphasised"), _signal_keys(F.col("tags")).alias("k_tags"), F.transform("anchors", T.lemma_key).alias("k_anchors")
    )
    df = candidates.join(s, "note_id", "left")
    has = lambda k, x: F.when(F.array_contains(k, F.col("lemma")), x).otherwise(0.0)
    named = F.size(F.filter("k_anchors", lambda a: a == F.col("lemma")))
    anchors = F.when(named > 0, F.least(F.lit(2.0), 1 + F.log(named.cast("double")))).otherwise(0.0)
    total = 1.0 + has("k_title", 1.0) + has("k_headings", 0.5) + has("k_emphasised", 0.3) + has("k_tags", 1.0) + anchors
    return df.select(*candidates.columns, F.coalesce(total, F.lit(1.0)).alias("structural"))


def score(measured: DataFrame, signals: tuple[str, ...] = ("yake", "idf")) -> DataFrame:
    """measured (note_id, lemma, yake, idf, ..., structural) with score: fused
    ranks by the multiplier, as a share of the note's best."""
    fused = reciprocal_rank_fusion(measured, "note_id", list(signals), "lemma", RRF_K)
    return fused.withColumn("raw", F.col("rrf") * F.col("structural")).withColumn("score", max_normalised("raw", "note_id")).drop("raw", "rrf")


def _signal_keys(c: Column) -> Column:
    """What texts name: their lemmas, whole and word by word."""
    whole = F.filter(F.transform(c, T.lemma_key), lambda k: k != "")
    return F.array_distinct(F.concat(whole, F.flatten(F.transform(whole, lambda k: F.split(k, " ")))))


#: What of a note names a term, by how much that adds to its multiplier.
NAMED_BY = {"title": 1.0, "headings": 0.5, "emphasised": 0.3, "tags": 1.0}
SCORED = [("lemma", "string"), ("text", "string"), ("kind", "string"), ("yake", "double"), ("idf", "double"), ("structural", "double"), ("score", "double")]
#: Of candidates (the notes' rows, their columns, their places within their notes, from 1) which to keep.
Keep = Callable[[np.ndarray, dict[str, pa.Array], np.ndarray], np.ndarray]


def _ranks(note: np.ndarray, value: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """As rank_of, within notes in order."""
    order = np.lexsort((tie, -np.round(value, 9), note))
    rank = np.empty(len(note), np.int64)
    rank[order] = np.arange(len(note)) - np.searchsorted(note, note) + 1
    return rank


def _order(words: pa.Array) -> np.ndarray:
    """Each word's place among all in order."""
    place = np.empty(len(words), np.int64)
    place[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    return place


def _among(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of wanted are among keys, and where each of these is."""
    order = np.argsort(keys)
    at = np.searchsorted(keys, wanted, sorter=order)
    there = np.flatnonzero(at < len(keys))
    there = there[keys[order[at[there]]] == wanted[there]]
    return there, order[at[there]]


def _lemma_keys(lists: pa.Array, words: pa.Array, named: pa.Array) -> np.ndarray:
    """Of the words of notes' lists one number for note and lemma, or -1."""
    code = pc.fill_null(pc.index_in(words, value_set=named), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(code < 0, -1, counting._rows_of(lists) * max(1, len(named)) + code)


def _multipliers(b: pa.RecordBatch, keys: np.ndarray, named: pa.Array) -> np.ndarray:
    """As structural."""
    out = np.ones(len(keys))
    of = lambda name: _among(keys, _lemma_keys(b[f"k_{name}"], b[f"k_{name}"].flatten(), named))[1]
    for name, weight in NAMED_BY.items():
        out[of(name)] += weight  # a list has a lemma once
    at, times = np.unique(of("anchors"), return_counts=True)
    out[at] += np.minimum(2.0, 1 + np.log(times))
    return out


def _scored(b: pa.RecordBatch, most: int, stop: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array], np.ndarray]:
    """_costed with what structural and score add, and each candidate's place in order."""
    note, columns = _costed(b, most, stop)
    named = pc.dictionary_encode(columns["lemma"])
    code, size, tie = named.indices.to_numpy(zero_copy_only=False), max(1, len(named.dictionary)), _order(named.dictionary)
    keys, known = note * size + code, b["known"].flatten()
    at, place = _among(_lemma_keys(b["known"], known.field("lemma"), named.dictionary), keys)
    idf = b["unknown"].to_numpy(zero_copy_only=False)[note]
    idf[at] = known.field("idf").to_numpy(zero_copy_only=False)[place]
    factor = _multipliers(b, keys, named.dictionary)
    raw = (1.0 / (RRF_K + _ranks(note, columns["yake"].to_numpy(), tie[code])) + 1.0 / (RRF_K + _ranks(note, idf, tie[code]))) * factor
    top = np.zeros(b.num_rows)
    np.maximum.at(top, note, raw)
    score = raw / top[note]
    return note, {**columns, "idf": pa.array(idf), "structural": pa.array(factor), "score": pa.array(score)}, _ranks(note, score, tie[code])


def scored_notes(notes: DataFrame, anchors: DataFrame, n: Column, keep: Keep | None = None, most: int = 4) -> DataFrame:
    """Of notes the candidates (note_id, SCORED), as structural and score give them
    from costed_candidates, with the notes' tags and titles and the anchors (note_id,
    anchors) of links to them; keep: which of them. How many notes have a lemma is sent
    to the notes that have it, and texts meet that once: candidates, of which there are
    far more, aren't moved."""
    stop, key = list(T.STOP_WORDS), dict(notes.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for x in batches for p in counting.pieces(x, "words", PIECE, pc.binary_length)):
            note, columns, place = _scored(b, most, pa.array(stop))
            if keep is not None:
                kept = keep(note, columns, place)
                note, columns = note[kept], {c: x.take(pa.array(kept)) for c, x in columns.items()}
            yield _batch(b, note, {c: columns[c] for c, _ in SCORED})

    lists = materialise(_lemma_rows(notes, True), "lemmas-of-pieces")
    idf = lists.groupBy("lemma").agg(F.sum("n").alias("df")).select("lemma", smoothed_idf(n, F.col("df")).alias("idf"))
    pairs = lists.join(idf, "lemma").select(F.explode("note_ids").alias("note_id"), F.struct("lemma", "idf").alias("one"))
    known = pairs.groupBy(F.col("note_id").alias("of")).agg(F.collect_list("one").alias("known"))
    both = notes.select("id", "title", "tag", "body").join(known, F.col("id").eqNullSafe(F.col("of")), "left").join(anchors, F.col("id") == F.col("note_id"), "left").drop("note_id")
    none = F.array().cast("array<string>")
    signals = {"title": F.array("title"), "headings": none, "emphasised": T.emphasised(F.col("body")), "tags": F.array("tag")}
    cut = both.select(
        F.col("id").alias("note_id"), *_texts(), F.coalesce("known", F.array().cast("array<struct<lemma:string,idf:double>>")).alias("known"), smoothed_idf(n, F.lit(0)).alias("unknown"),
        *[_signal_keys(c).alias(f"k_{name}") for name, c in signals.items()], F.transform("anchors", T.lemma_key).alias("k_anchors"),
    )
    return cut.mapInArrow(run, f"note_id {key}, " + ", ".join(f"{c} {t}" for c, t in SCORED))


def pool_size(top_n: int, top_p: int) -> int:
    """How many of a note's best are worth an embedding."""
    return max(top_n + top_p, 25)


def in_pool(top_n: int, top_p: int) -> Keep:
    """As candidate_pool."""
    return lambda note, columns, place: np.flatnonzero(place <= pool_size(top_n, top_p))


def candidate_pool(scored: DataFrame, top_n: int, top_p: int) -> DataFrame:
    """The best of each note that are worth an embedding."""
    w = W.partitionBy("note_id").orderBy(F.round("score", 9).desc(), "lemma")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= pool_size(top_n, top_p)).drop("place")


def _lists(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(note_id, rows): a note's rows as one list."""
    return rows.groupBy("note_id").agg(F.collect_list(F.struct(*columns)).alias("rows"))


def _row_of(lists: pa.Array) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def embedding_scores(pool: DataFrame, note_vectors: DataFrame, model) -> DataFrame:
    """pool with embedding: the cosine of each candidate and its note's mean vector. A
    lemma is embedded in its least text, once for each piece of 256 notes: the vectors
    of lemmas aren't moved, and a note's goes with the list of its candidates."""
    from ..functions import embedding as E

    encoder, every = E._ENCODERS.get(model.name), pool.columns
    names = [c for c in every if c != "note_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            at, rows = _row_of(b["rows"]), b["rows"].flatten()
            texts = pc.dictionary_encode(pc.fill_null(rows.field("any_text"), ""))
            lemmas = np.array(E.encode(texts.dictionary.to_pylist(), model, False, encoder), np.float64).reshape(-1, model.dim)
            means = np.zeros((b.num_rows, model.dim))
            for i, v in enumerate(b["note_vec"]):
                if v.is_valid:
                    means[i] = v.values.to_numpy(zero_copy_only=False)
            size = lambda m: np.sqrt((m * m).sum(axis=1))
            code = texts.indices.to_numpy(zero_copy_only=False)
            by = size(lemmas)[code] * size(means)[at]
            dot = np.einsum("ij,ij->i", lemmas[code], means[at])
            near = pa.array(np.where(by > 0, dot / np.where(by > 0, by, 1), 0.0))
            columns = {"note_id": b["note_id"].take(pa.array(at)), **{c: rows.field(c) for c in names}, "embedding": near}
            yield pa.RecordBatch.from_arrays([columns[c] for c in (*every, "embedding")], [*every, "embedding"])

    texts = pool.groupBy("lemma").agg(F.min("text").alias("any_text"))
    lists = _lists(pool.join(texts, "lemma"), [*names, "any_text"])
    near = lists.join(note_vectors.select("note_id", F.col("vec").cast("array<double>").alias("note_vec")), "note_id", "left").select("note_id", "rows", "note_vec")
    return near.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in pool.dtypes], "embedding double"]))


def collapse(terms: list[tuple[str, str]]) -> list[int]:
    """Of (lemma, kind), best first: the places of those not within a kept one
    of their kind. Single words always stay."""
    return list(_collapsed(terms))


def _collapsed(terms: list[tuple]) -> Iterator[int]:
    """As collapse, each place as it is asked for. What is within a term that went is
    within the one for which that went, so runs of all terms' words are looked up."""
    sizes = {t[0].count(" ") + 1 for t in terms} - {1}
    within: set[tuple] = set()
    for i, (lemma, kind, *_) in enumerate(terms):
        if " " not in lemma:
            yield i
            continue
        w = lemma.split(" ")
        if (kind, *w) not in within:
            yield i
            within.update([(kind, *w[j : j + n]) for n in sizes if n < len(w) for j in range(len(w) - n + 1)])


def diversify(terms: list[tuple[str, float]], trade: float, limit: int) -> list[int]:
    """Places of up to limit (lemma, score; best first up to the ninth digit), each next
    one the best by score less its likeness to those chosen."""
    return _diverse(lambda i: terms[i] if i < len(terms) else None, trade, limit)


def _diverse(terms: Callable[[int], tuple[str, float] | None], trade: float, limit: int) -> list[int]:
    """As diversify, of terms asked for by place (None after the last). Those whose
    score alone is less aren't looked at."""
    words: list[frozenset] = []
    nearest: list[tuple[float, int]] = []  # the likeness to so many of the chosen
    chosen: list[int] = []
    while len(chosen) < limit:
        best, place, i = -math.inf, -1, -1
        while (one := terms(i := i + 1)) is not None:
            if trade > 0 and place >= 0 and trade * (one[1] + 1e-9) < best or trade >= 1 and place >= 0:
                break
            if i in chosen:
                continue
            if i == len(words):
                words.append(frozenset(one[0].split(" ")))
                nearest.append((0.0, 0))
            near, seen = nearest[i]
            if trade < 1 and seen < len(chosen):
                for j in chosen[seen:]:
                    both = len(words[i] & words[j])
                    near = max(near, both / (len(words[i]) + len(words[j]) - both))
                nearest[i] = near, len(chosen)
            value = trade * one[1] - (1 - trade) * near
            if place < 0 or value > best:
                best, place = value, i
        if place < 0:
            break
        chosen.append(place)
    return chosen


class _More(Exception):
    """The best of a note's terms weren't enough."""


def _picked(terms: list[tuple[str, str, float]], top_n: int, top_p: int, trade: float, whole: bool = True) -> list[int]:
    """Places of those of a note's (lemma, kind, score), best first, that are selected.
    No more of them are looked at than may be; whole: these are all."""
    left = _collapsed(terms)
    mine: dict[str, list[int]] = {"keyword": [], "phrase": []}

    def of(kind: str, i: int) -> tuple[str, float] | None:
        while len(mine[kind]) <= i:
            if (k := next(left, None)) is None:
                if not whole:
                    raise _More
                return None
            if terms[k][1] in mine:
                mine[terms[k][1]].append(k)
        return terms[mine[kind][i]][::2]

    return [mine[kind][i] for kind, limit in (("keyword", top_n), ("phrase", top_p)) for i in _diverse(partial(of, kind), trade, limit)]


#: Of a note's terms those that are looked at first; all others only if these aren't enough.
HEAD = 128


def selected(top_n: int = 12, top_p: int = 6, trade: float = 0.7) -> Keep:
    """As select_terms."""

    def keep(note: np.ndarray, columns: dict[str, pa.Array], place: np.ndarray) -> np.ndarray:
        order = np.lexsort((place, note))
        starts = np.flatnonzero(np.diff(note, prepend=-1)).tolist()
        some = [columns[c].take(pa.array(order)) for c in ("lemma", "kind", "score")]
        terms = lambda a, z: list(zip(*(x.slice(a, z - a).to_pylist() for x in some), strict=True))
        kept = []
        for a, z in zip(starts, [*starts[1:], len(note)], strict=True):
            try:
                mine = _picked(terms(a, min(z, a + HEAD)), top_n, top_p, trade, z - a <= HEAD)
            except _More:
                mine = _picked(terms(a, z), top_n, top_p, trade)
            kept += [a + i for i in mine]
        return order[kept]

    return keep


def select_terms(scored: DataFrame, top_n: int = 12, top_p: int = 6, trade: float = 0.7) -> DataFrame:
    """Each note's keywords and phrases: nested phrases collapsed, then diverse."""
    every, keep = scored.columns, selected(top_n, top_p, trade)
    names = [c for c in every if c != "note_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            at, rows = _row_of(b["rows"]), b["rows"].flatten()
            named = pc.dictionary_encode(rows.field("lemma"))
            place = _ranks(at, rows.field("score").to_numpy(zero_copy_only=False), _order(named.dictionary)[named.indices.to_numpy()])
            kept = keep(at, {c: rows.field(c) for c in names}, place)
            columns = {"note_id": b["note_id"].take(pa.array(at[kept])), **{c: rows.field(c).take(pa.array(kept)) for c in names}}
            yield pa.RecordBatch.from_arrays([columns[c] for c in every], every)

    return _lists(scored, names).mapInArrow(run, scored.schema)


# ---- vocabulary ----


gazetteer_matches = gazetteer_search.matches


def without_blocked(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    return candidates.join(terms.where("blocked").select("lemma").distinct(), "lemma", "left_anti")


def above_floor(scored: DataFrame, manual: DataFrame, floor: float) -> DataFrame:
    """Scores of at least floor, but for lemmas that the note has by hand."""
    return scored.where(F.col("score") >= floor).join(manual.select("note_id", "lemma").distinct(), ["note_id", "lemma"], "left_anti")


def document_frequencies(note_terms: DataFrame) -> DataFrame:
    return note_terms.groupBy("term_id").agg(F.count_distinct("note_id").alias("df"))


def promotion_candidates(note_terms: DataFrame, terms: DataFrame, min_df: int = 3, min_score: float = 0.5, limit: int = 50) -> DataFrame:
    """Automatic terms that enough notes have with a high enough best score."""
    auto = terms.where("source = 'auto' and not blocked").select(F.col("id").alias("term_id"), "term")
    best = note_terms.join(auto, "term_id").groupBy("term_id", "term").agg(F.max("score").alias("best"), F.count_distinct("note_id").alias("df"))
    return best.where((F.col("df") >= min_df) & (F.col("best") >= min_score)).orderBy(F.col("df").desc(), F.round("best", 9).desc(), "term").limit(limit)


def upsert_terms(terms: DataFrame, new: DataFrame) -> DataFrame:
    """terms with new (term, lemma, source, weight) merged by lemma: by hand wins
    over automatic and never goes back; flags stay."""
    fresh = new.groupBy("lemma").agg(F.max_by(F.struct("term", "source", "weight"), F.struct(F.col("source") == "manual", "weight", "term")).alias("n"))
    top = terms.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbers = row_numbers(fresh.join(terms.select("lemma"), "lemma", "left_anti").select("lemma"), "lemma", "number")
    both = terms.join(fresh, "lemma", "full_outer").join(numbers, "lemma", "left")
    promoted = (F.col("n.source") == "manual") | (F.col("source") == "manual")
    return both.select(
        F.coalesce("id", F.lit(top) + F.col("number")).alias("id"), F.coalesce("term", "n.term").alias("term"), "lemma", F.when(promoted, "manual").otherwise("auto").alias("source"),
        F.coalesce("pinned", F.lit(False)).alias("pinned"), F.coalesce("blocked", F.lit(False)).alias("blocked"), F.greatest(F.coalesce("weight", F.col("n.weight")), F.coalesce(F.col("n.weight"), "weight")).alias("weight"), F.coalesce("df", F.lit(0)).alias("df"),
    )


def set_flags(terms: DataFrame, lemma: str, pinned: bool | None = None, blocked: bool | None = None, weight: float | None = None) -> DataFrame:
    mine = F.col("lemma") == lemma
    for name, value in (("pinned", pinned), ("blocked", blocked), ("weight", weight)):
        if value is not None:
            terms = terms.withColumn(name, F.when(mine, F.lit(value)).otherwise(F.col(name)))
    return terms


def vocabulary(terms: DataFrame, limit: int = 200) -> DataFrame:
    return terms.orderBy(F.col("df").desc(), "term").limit(limit)


def terms_of(note_terms: DataFrame, terms: DataFrame) -> DataFrame:
    """(note_id, term, kind, score, source) with a place in each note's order."""
    named = note_terms.join(terms.select(F.col("id").alias("term_id"), "term"), "term_id")
    w = W.partitionBy("note_id").orderBy(F.col("score").desc(), "term")
    return named.withColumn("place", F.row_number().over(w)).select("note_id", "place", "term", "kind", "score", "source")


def find_term(terms: DataFrame, text: str) -> DataFrame:
    """The term whose lemma text has."""
    return terms.where(F.col("lemma") == T.lemma_key(F.lit(text)))


def require_term(terms: DataFrame, text: str) -> DataFrame:
    found = find_term(terms, text)
    if found.isEmpty():
        raise NotFound(f'no term "{text}"', {"term": text})
    return found


def inverted(cost: Column) -> Column:
    """A cost, low for good keywords, as a score up to 1; 0 where there is none."""
    return F.when(cost.isNotNull(), 1 / (1 + cost)).otherwise(0.0)


def kind_of(words: Column) -> Column:
    """Three words or more make a phrase."""
    return F.when(words >= 3, "phrase").otherwise("keyword")


def attach_manual(selected: DataFrame, matches: DataFrame) -> DataFrame:
    """The terms of notes: those found by hand-made lists (note_id, term), always
    and with score 1, and the selected ones (note_id, lemma, text, kind, score)
    whose lemmas aren't among those."""
    manual = matches.select("note_id", "term", T.lemma_key(F.col("term")).alias("lemma"), kind_of(F.size(F.split(T.trim_all(F.col("term")), r"\s+"))).alias("kind"), F.lit(1.0).alias("score"), F.lit("manual").alias("source"))
    auto = selected.join(manual.select("note_id", "lemma").distinct(), ["note_id", "lemma"], "left_anti")
    return manual.unionByName(auto.select("note_id", F.col("text").alias("term"), "lemma", "kind", "score", F.lit("auto").alias("source")))


def vocabulary_view(terms: DataFrame, note_terms: DataFrame, config: dict, limit: int = 200) -> dict:
    """The vocabulary, what may be promoted to it, and from which thresholds on."""
    k = config["keywords"]
    thresholds = {"min_df": k["promoteMinDf"], "min_score": k["promoteMinScore"]}
    return {"terms": vocabulary(terms, limit), "candidates": promotion_candidates(note_terms, terms, **thresholds), "thresholds": thresholds}


def gazetteer(terms: DataFrame) -> DataFrame:
    """Terms that are always looked for, the longest first."""
    return terms.where("source = 'manual' and not blocked").orderBy(F.length("term").desc(), "term")
