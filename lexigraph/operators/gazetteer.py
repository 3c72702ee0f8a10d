"""Literal terms in texts: every text passes the terms, no word is a join key.

Terms are dealt by hash to shards of bounded size. For each shard the texts stream
past in tasks that build its matcher once: plain words are looked up among a text's
own, and all other terms found by an Aho-Corasick automaton, which reads a text once
whatever the number of terms. The driver holds one shard's terms at a time; texts are
neither shuffled nor written, and what a task sends on is what it found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

#: Bytes of a shard's terms: of plain words, and of others, whose automaton has a node for each character.
WORD_BYTES, OTHER_BYTES = 8 << 20, 1 << 20
#: Characters of a text whose words are listed at once.
PIECE = 1 << 20
WORD = re.compile("[a-z0-9]+")
PART = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _words(text: str) -> set[str]:
    """The distinct words of a text, which is cut between words only."""
    out: set[str] = set()
    begin = 0
    while begin < len(text):
        end = min(len(text), begin + PIECE)
        while end < len(text) and text[end] in PART and text[end - 1] in PART:
            end += 1
        out.update(WORD.findall(text, begin, end))
        begin = end
    return out


def _scan(words: dict[str, list[str]], others: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, automaton = frozenset(words), ahocorasick.Automaton()
        for term in others:
            automaton.add_word(term, (len(term), term))
        if others:
            automaton.make_automaton()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                row, found = [], []
                for i, text in enumerate(part["text"].to_pylist()):
                    mine = [t for w in known & _words(text) for t in words[w]] if words else []
                    if others:
                        seen = set()
                        for end, (n, term) in automaton.iter(text):
                            begin = end + 1 - n
                            if term not in seen and not (begin and text[begin - 1] in PART) and not (end + 1 < len(text) and text[end + 1] in PART):
                                seen.add(term)
                        mine += [t for term in seen for t in others[term]]
                    row += [i] * len(mine)
                    found += mine
                yield pa.RecordBatch.from_arrays([part["note_id"].take(pa.array(row, pa.int64())), pa.array(found, pa.string())], ["note_id", "term"])

    return run


def _shards(terms: DataFrame, most: int) -> Iterator[dict[str, list[str]]]:
    """Each shard's terms by what is looked for."""
    size = terms.agg(F.sum(F.octet_length("low") + F.octet_length("term")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // most))
    for i in range(n):
        found: dict[str, list[str]] = {}
        rows = terms.where(F.pmod(F.xxhash64("low"), F.lit(n)) == i).toArrow()
        for low, term in zip(rows["low"].to_pylist(), rows["term"].to_pylist(), strict=True):
            found.setdefault(low, []).append(term)
        if found:
            yield found


def matches(notes: DataFrame, terms: DataFrame) -> DataFrame:
    """(note_id, term): the terms (term) that stand in notes (id, body) with no
    ASCII letter or digit beside them, case aside, each once. Null and empty terms
    are in no text, null texts have none; rows of one id are one note."""
    low = F.lower("term")
    kept = materialise(terms.select("term", low.alias("low"), low.rlike("^[a-z0-9]+$").alias("plain")).where("low != ''").distinct(), "gazetteer-terms")
    texts = notes.select(F.col("id").alias("note_id"), F.lower(F.coalesce("body", F.lit(""))).alias("text"))
    id_type = dict(texts.dtypes)["note_id"]
    scan = lambda w, o: texts.mapInArrow(_scan(w, o), f"note_id {id_type}, term string")
    found = [scan(w, {}) for w in _shards(kept.where("plain"), WORD_BYTES)] + [scan({}, o) for o in _shards(kept.where("not plain"), OTHER_BYTES)]
    if not found:
        return texts.select("note_id", F.lit("").alias("term")).limit(0)
    every = reduce(DataFrame.unionByName, found)
    # A term is found once in a row; only ids that several rows have can bring it twice.
    several = materialise(notes.groupBy(F.col("id").alias("several")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("several"), "gazetteer-ids")
    if several.isEmpty():
        return every
    same = F.col("note_id").eqNullSafe(F.col("several"))
    return every.join(several, same, "left_anti").unionByName(every.join(several, same, "left_semi").distinct())
