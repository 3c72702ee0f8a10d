"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put in another order.

Units are lines, each with its line feed. A unit starts at the first byte and
after each line feed, so whether one starts at a byte depends on that byte and
the one before it. A text's UTF-8 bytes are cut into chunks, each with the byte
before it as overlap (the first with a line feed in its place). The starts in
every chunk are counted independently of all others; prefix sums over the counts
say in which chunk the unit of a given rank starts; only the two chunks that own
the text's cuts are looked into again. A line feed is never part of another
character, so chunks may end within one.

All of it is column expressions on the text's own row: the bytes are in that task
already, nothing is shuffled, and memory is a few copies of one text.

Defined results: a null text is an empty one; an empty text and one with a marker
in it are plain, as are those outside the rate, and have no cut; a null id counts
as no digits. Rows with equal ids and texts give equal rows. A very long text has
more chunks, each read once and two of them twice. No rows give no rows. Columns
of the input other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk.
CHUNK = 1 << 15
MARKERS = ("<P>", "<S>", "<M>")
LF = "\n"


def _draw(digest: Column, which: int) -> Column:
    """The which-th group of eight hexadecimal digits, as a number."""
    return F.conv(F.substring(digest, 8 * which + 1, 8), 16, 10).cast("long")


def _seen_from(raw: Column, chunk: Column, size: int) -> Column:
    """The bytes before those of a chunk: one start in it for each line feed here."""
    first = F.concat(F.lit(LF).cast("binary"), F.substring(raw, F.lit(1), F.least(F.lit(size), F.octet_length(raw)) - 1))
    # The byte before the chunk's first, and all of it but the last one of the text.
    begin = chunk * size
    return F.when(chunk == 0, first).otherwise(F.substring(raw, begin, F.least(F.lit(size), F.octet_length(raw) - begin))).cast("string")


def starts_in_chunks(raw: Column, size: int = CHUNK) -> Column:
    """How many lines start in each chunk of a text's bytes."""
    chunks = F.ceil(F.octet_length(raw) / size).cast("int")
    count = lambda i: F.octet_length(s := _seen_from(raw, i, size)) - F.octet_length(F.replace(s, F.lit(LF), F.lit("")))
    return F.when(chunks > 0, F.transform(F.sequence(F.lit(0), chunks - 1), count)).otherwise(F.array().cast("array<int>"))


def prefix_sums(counts: Column) -> Column:
    """Of an array: what all entries before each one, and before its end, add up to."""
    return F.aggregate(counts, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def owner(before: Column, rank: Column) -> Column:
    """The chunk in which the unit of a rank (from 0) starts: of the prefix sums the
    last one up to the rank."""
    return (F.array_size(F.filter(before, lambda s: s <= rank)) - 1).cast("int")


def cut_at(raw: Column, before: Column, rank: Column, size: int = CHUNK) -> Column:
    """The byte that the unit of a rank starts at, by a look into its chunk alone;
    the text's end for the rank after the last."""
    chunk = owner(before, rank)
    local = (rank - F.element_at(before, chunk + 1)).cast("int")
    inside = F.octet_length(F.call_function("substring_index", _seen_from(raw, chunk, size), F.lit(LF), local + 1))
    return F.when(rank >= F.element_at(before, -1), F.octet_length(raw)).otherwise(chunk * size + inside)


def rearrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, markers: tuple[str, str, str] = MARKERS, chunk: int = CHUNK) -> DataFrame:
    """Returns id_col, n (lines), form (plain, psm, spm), prefix_chars,
    middle_chars and output (text). rate and spm_rate are percentages."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("doc"), digest.alias("digest"), text.alias("whole"))
    rows = rows.withColumn("raw", F.col("whole").cast("binary")).withColumn("before", prefix_sums(starts_in_chunks(F.col("raw"), chunk)))
    rows = rows.withColumn("n", F.element_at("before", -1))
    one, two = (F.pmod(_draw(F.col("digest"), i), F.col("n") + 1) for i in (0, 1))
    rows = rows.withColumn("lo", F.least(one, two)).withColumn("hi", F.greatest(one, two))
    marked = F.contains("whole", F.lit(markers[0])) | F.contains("whole", F.lit(markers[1])) | F.contains("whole", F.lit(markers[2]))
    plain = (F.octet_length("whole") == 0) | marked | (_draw(F.col("digest"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(F.col("digest"), 3) % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    at = [F.when(F.col("form") != "plain", cut_at(F.col("raw"), F.col("before"), F.col(x), chunk)) for x in ("lo", "hi")]
    rows = rows.withColumn("cut1", at[0].cast("int")).withColumn("cut2", at[1].cast("int"))
    part = lambda begin, end: F.substring(F.col("raw"), begin + 1, end - begin).cast("string")
    end = F.octet_length("raw")
    rows = rows.select("doc", "n", "form", "whole", part(F.lit(0), F.col("cut1")).alias("prefix"), part(F.col("cut1"), F.col("cut2")).alias("middle"), part(F.col("cut2"), end).alias("suffix"))
    p, s, m = map(F.lit, markers)
    output = F.when(F.col("form") == "plain", F.col("whole")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    return rows.select(F.col("doc").alias(id_col), "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of. No part has a marker in it, so each
    marker's first place is its own."""
    p, s, m = markers
    after = lambda x, mark: F.substring(x, F.locate(mark, x) + len(mark), F.length(x))
    upto = lambda x, mark: F.substring(x, F.lit(1), F.locate(mark, x) - 1)
    prefix, middle = after(upto(output, s), p), after(output, m)
    psm = F.concat(prefix, middle, after(upto(output, m), s))
    spm = F.concat(after(upto(output, m), p), middle, after(upto(output, p), s))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
