"""Known words within some edits of those asked for.

The vocabulary is dealt to ranges and sorted, which makes each range a trie read in
order: neighbours share their beginnings. A word asked for walks it as a Levenshtein
automaton does. The state after some letters is the row of edit distances to each
beginning of the word, as far as they are within the tolerance; a word's letters that
are the last one's aren't read again; and once no distance is within the tolerance all
words that begin so are passed over at once. Rows found grow with the words asked for,
not with the vocabulary. The words asked for go to the tasks in blocks of ASKED.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

ASKED, MOST = 5_000, 3


def _step(row: list[int], letter: str, asked: str, k: int) -> list[int]:
    """The distances after one more letter; what is beyond k is k + 1."""
    far = k + 1
    new = [min(far, row[0] + 1)]
    for i, a in enumerate(asked):
        new.append(min(row[i] if a == letter else row[i] + 1, row[i + 1] + 1, new[i] + 1, far))
    return new


def walk(words: list[str], asked: str, k: int) -> Iterator[str]:
    """Of sorted distinct words those within k edits of asked."""
    rows, last, at = [[min(i, k + 1) for i in range(len(asked) + 1)]], "", 0
    while at < len(words):
        word = words[at]
        same = 0
        while same < min(len(rows) - 1, len(word)) and word[same] == last[same]:
            same += 1
        del rows[same + 1 :]
        dead = None
        for depth in range(same, len(word)):
            rows.append(_step(rows[-1], word[depth], asked, k))
            if min(rows[-1]) > k:
                dead = word[: depth + 1]
                break
        last = word
        if dead is None:
            if rows[-1][-1] <= k:
                yield word
            at += 1
        else:
            rows.pop()
            last = dead[:-1]
            # The first word that doesn't begin so.
            at = bisect_left(words, dead[:-1] + chr(ord(dead[-1]) + 1), at + 1) if ord(dead[-1]) < 0x10FFFF else next((i for i in range(at + 1, len(words)) if not words[i].startswith(dead)), len(words))


def _search(asked: list[str], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task may have several runs of the order.
        words = sorted(w for b in batches for w in b["token"].to_pylist())
        for one in asked:
            found = list(walk(words, one, k))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(found)), pa.array(found)], ["asked", "token"])

    return run


def near_words(asked: DataFrame, vocabulary: DataFrame, k: int) -> DataFrame:
    """(asked, token): the vocabulary's words (token) within k edits, 0 to MOST, of
    each of asked (asked). Null words are near none."""
    if not 0 <= k <= MOST:
        raise ValueError(f"a tolerance of 0 to {MOST}")
    spark = asked.sparkSession
    words = materialise(asked.select("asked").where("asked is not null").distinct(), "typos-asked")
    known = materialise(vocabulary.select("token").where("token is not null").distinct().repartitionByRange("token").sortWithinPartitions("token"), "typos-words")
    n = -(-words.count() // (ASKED // 2))
    found = []
    for i in range(n):
        block = sorted(r[0] for r in words.where(F.pmod(F.xxhash64("asked"), F.lit(n)) == i).collect())
        found.append(known.mapInArrow(_search(block, k), "asked string, token string"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "asked string, token string")
