"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no subject of their own.
STOP_WORDS = """
a about above after again against all also am an and any are as at be because been before being below between both
but by can cannot could did do does doing down during each either else few for from further had has have having he her
here hers herself him himself his how however i if in into is it its itself just let like may me might more most
must my myself no nor not now of off on once only or other ought our ours ourselves out over own per rather same
shall she should so some still such than that the their theirs them themselves then there therefore these they this those
through to too under until up very was we were what when where whether which while who whom why will with would you
your yours yourself yourselves
case cases end example examples fact kind lot matter means part parts point points something sort stuff thing things time
times way ways
appendix conclusion introduction overview summary
""".split()

#: Writing systems that the language gate rejects.
SCRIPTS = ("Cyrillic", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Devanagari", "Thai", "Armenian", "Georgian")

BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim_all(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def normalise(c: Column) -> Column:
    """Line ends as \\n, no blanks before them or at the ends."""
    unix = F.regexp_replace(c, "\r\n", "\n")
    return trim_all(F.regexp_replace(unix, r"[ \t]+(?=[\n\r\x{2028}\x{2029}]|\z)", ""))


def text_hash(c: Column) -> Column:
    return F.sha2(normalise(c), 256)


def tokens(c: Column) -> Column:
    """Words with the inner punctuation of technical names."""
    bare = F.transform(F.split(F.lower(c), r"[^a-z0-9_+#.-]+"), lambda t: F.regexp_replace(t, r"^[.\-_]+|[.\-_]+$", ""))
    return F.filter(bare, lambda t: (F.length(t) > 1) & t.rlike("[a-z]"))


def search_tokens(c: Column) -> Column:
    """Words of the inverted index: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))


#: The regular plurals. Endings that stay; endings with how many
#: letters go and what takes their place, the first that fits.
NO_PLURAL, SHORTEST = "(ss|us|is|as|os)$", 4
PLURALS = (("[^aeiou]ies$", 3, "y"), ("(ch|sh|s|x|z)es$", 2, ""), ("[^s]s$", 1, ""))


def singular(word: Column) -> Column:
    """The regular English singular of a word, where it has one."""
    w = F.lower(word)
    out = F.when((F.length(w) < SHORTEST) | w.rlike(NO_PLURAL), w)
    for ending, gone, instead in PLURALS:
        out = out.when(w.rlike(ending), F.concat(F.substring(w, F.lit(1), F.length(w) - gone), F.lit(instead)))
    return out.otherwise(w)


def lemma_key(c: Column) -> Column:
    """What makes two forms of a phrase one term."""
    return F.array_join(F.transform(tokens(c), singular), " ")


def sentences(c: Column) -> Column:
    cut = F.split(c, r"(?<=[.!?])\s+|\n{2,}|\n(?=[-*#>|])")
    return F.filter(F.transform(cut, trim_all), lambda s: s != "")


def yake_words(sentence: Column) -> Column:
    return F.filter(F.split(sentence, r"[^A-Za-z0-9_+#.-]+"), lambda w: F.length(w) > 1)


def strip_fenced(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?ms)^```.*?^```", ""), r"(?ms)^~~~.*?^~~~", "")


def strip_code(c: Column) -> Column:
    return F.regexp_replace(strip_fenced(c), r"`[^`\n]*`", "")


def emphasised(c: Column) -> Column:
    """Bold text and inline code of less than 60 characters."""
    bold = F.regexp_extract_all(c, F.lit(r"\*\*([^*\n]+)\*\*"), F.lit(1))
    code = F.regexp_extract_all(c, F.lit(r"`([^`\n]+)`"), F.lit(1))
    return F.filter(F.transform(F.concat(bold, code), trim_all), lambda x: (x != "") & (F.length(x) < 60))


def heading_path(path: Column) -> Column:
    named = F.filter(path, lambda x: F.trim(x) != "")
    return F.when(F.size(named) > 0, F.array_join(named, " > "))


def approximate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(trim_all(c)) / 4)).cast("int")


def hashing_tokens(c: Column) -> Column:
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")
    return F.greatest(F.lit(1), F.size(words))


def count_occurrences(text: Column, phrase: Column) -> Column:
    """How often phrase occurs in text, regardless of case, without overlaps."""
    low, sought = F.lower(text), F.lower(phrase)
    shrunk = F.length(low) - F.length(F.replace(low, sought, F.lit("")))
    return F.when(F.length(sought) > 0, (shrunk / F.length(sought)).cast("int")).otherwise(0)


def whole_word(text: Column, phrase: Column) -> Column:
    """Whether phrase stands in text with no letter or digit beside it."""
    quoted = F.concat(F.lit(r"(?s)(^|[^a-z0-9])\Q"), F.lower(phrase), F.lit(r"\E([^a-z0-9]|$)"))
    return F.when(F.length(phrase) > 0, F.regexp_like(F.lower(text), quoted)).otherwise(False)


#: A character of a rejected script. None of them lies before Greek, so that most
#: characters of most texts need no look at the scripts.
BLOCKED = r"[\x{370}-\x{10FFFF}&&[" + "".join(rf"\p{{Is{s}}}" for s in SCRIPTS) + "]]"


def blocked_name(c: Column) -> Column:
    """The rejected script of a text's earliest character of one, or null. Unlike
    blocked_script's, this may be what a Python function gets."""
    return _script_of(F.nullif(F.regexp_extract(c, BLOCKED, 0), F.lit("")))


def _script_of(char: Column) -> Column:
    # A script's name has no character of another.
    return reduce(lambda x, s: F.regexp_replace(x, rf"^\p{{Is{s}}}$", s), SCRIPTS, char)


def blocked_script(c: Column) -> Column:
    """The earliest character of a rejected script: script, char, index from 0,
    line and column from 1; null where there is none. A text is searched once."""
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def found(upto: Column, char: Column) -> Column:
        line = F.length(upto) - F.length(F.replace(upto, F.lit("\n"), F.lit(""))) + 1
        column = F.length(F.substring_index(upto, "\n", -1)) + 1
        return F.struct(_script_of(char).alias("script"), char.alias("char"), F.length(upto).alias("index"), line.alias("line"), column.alias("column"))

    def search(text: Column) -> Column:
        at = lambda cut: once(F.substring(text, F.length(cut[0]) + 1, F.lit(1)), lambda char: found(cut[0], char))
        return once(F.split(text, BLOCKED, 2), lambda cut: F.when(F.size(cut) > 1, at(cut)))

    return once(c, search)


def gate(c: Column, mode: str = "strict", gate_code: bool = False) -> Column:
    """ok, warning and finding of the language gate."""
    finding = blocked_script(c if gate_code else strip_code(c))
    if mode == "off":
        finding = F.when(F.lit(False), finding)
    ok = finding.isNull() | F.lit(mode == "warn")
    return F.struct(ok.alias("ok"), (finding.isNotNull() & F.lit(mode == "warn")).alias("warning"), finding.alias("finding"))


NOTE_ID = r"^([A-Z][A-Z0-9]{1,3})-(\d{4,})$"


def note_id(prefix: str, seq: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.when(F.length(seq.cast("string")) < 4, F.lpad(seq.cast("string"), 4, "0")).otherwise(seq.cast("string")))


def is_note_id(c: Column) -> Column:
    return c.rlike(NOTE_ID)


def id_prefix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, NOTE_ID, 1), F.lit(""))


def id_sequence(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, NOTE_ID, 2), F.lit("")).cast("long")


def derive_prefix(name: Column) -> Column:
    """A project's id prefix: its words' initials, or three letters of its only word."""
    words = F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda w: w.rlike("^[A-Za-z]"))
    initials = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    found = F.when(F.length(initials) >= 2, F.substring(initials, 1, 4)).otherwise(F.upper(F.substring(F.get(words, F.lit(0)), 1, 3)))
    return F.when(found.rlike("^[A-Z][A-Z0-9]{1,3}$"), found)


EXTERNAL = r"(?i)^[a-z][a-z0-9+.-]*:"


def is_external(c: Column) -> Column:
    return c.rlike(EXTERNAL)


def attachments(c: Column) -> Column:
    """Targets of ![alt](path) and ![[file]] that aren't elsewhere."""
    linked = F.regexp_extract_all(c, F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))
    embedded = F.regexp_extract_all(c, F.lit(r"!\[\[([^\]\n|#]+)"), F.lit(1))
    return F.filter(F.transform(F.concat(linked, embedded), trim_all), lambda t: (t != "") & ~is_external(t))


def export_filename(id_: Column, title: Column) -> Column:
    clean = F.substring(trim_all(F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|]', " "), r"\s+", " ")), 1, 120)
    return F.when(clean == "", F.concat(id_, F.lit(".md"))).otherwise(F.concat(id_, F.lit(" "), clean, F.lit(".md")))


def id_of_filename(c: Column) -> Column:
    lead = F.get(F.split(F.regexp_replace(c, r"(?i)\.md$", ""), r"\s+"), F.lit(0))
    return F.when(is_note_id(lead), lead)


def title_or_first_line(title: Column, body: Column) -> Column:
    """A given title, or the first line with words, without its # marks."""
    lines = F.filter(F.transform(F.split(body, "\n"), trim_all), lambda x: x != "")
    first = F.substring(trim_all(F.regexp_replace(F.get(lines, F.lit(0)), "^#+", "")), 1, 120)
    return F.coalesce(F.nullif(trim_all(title), F.lit("")), first)


def file_reference(target: Column) -> Column:
    """The name a link's target gives to a file, if it names one."""
    t = trim_all(target)
    bare = F.get(F.split(F.get(F.split(t, "#"), F.lit(0)), r"\?"), F.lit(0))
    base = F.element_at(F.split(bare, r"[\\/]"), -1)
    name = trim_all(F.regexp_replace(base, r"(?i)\.(md|markdown)$", ""))
    names = ~is_external(t) & (bare.rlike(r"(?i)\.(md|markdown)$") | bare.rlike(r"[\\/]"))
    return F.when(names & (name != ""), name)


def resolve_path(from_path: Column, target: Column) -> Column:
    """The path that target names, seen from from_path: .. and . folded away."""
    t = F.get(F.split(F.get(F.split(trim_all(target), "#"), F.lit(0)), r"\?"), F.lit(0))
    folder = F.split(from_path, "/")
    base = F.slice(folder, 1, F.greatest(F.size(folder) - 1, F.lit(0)))
    start = F.when(t.startswith("/"), F.array().cast("array<string>")).otherwise(base)
    parts = F.filter(F.split(F.replace(t, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    folded = F.aggregate(
        parts, start, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    )
    joined = F.regexp_replace(F.array_join(folded, "/"), r"(?i)\.(md|markdown)$", "")
    return F.when(~is_external(t) & (t != "") & (joined != ""), joined)


def source_path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "^(\\./)+", "")


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; lengths must agree."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    size = lambda v: F.sqrt(dot(v, v))
    return F.when((size(a) > 0) & (size(b) > 0), dot(a, b) / (size(a) * size(b))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
