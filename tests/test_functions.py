"""Functions on small cases: markdown, passages, diffs, vectors, settings, text."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraph import config
from lexigraph.errors import BadRequest, NotFound
from lexigraph.functions import chunking, diffing, embedding, markdown
from lexigraph.functions import text as T

NOTE = """# Lighting

An intro with **weight** and `shade()`, see [[LT-0002|the lamp]].

## Lamps
1. first lamp
   goes on
2. second [here](./rooms/hall.md)

```py
x = "[[LT-0009]]"
```

#### Deep
> quoted [[LT-0003#Glow]]

| a | b |
| - | - |
| 1 | 2 |
"""


def test_markdown_blocks():
    p = markdown.parse(NOTE)
    assert p["title"] == "Lighting" and [h["depth"] for h in p["headings"]] == [1, 2, 4]
    assert [(b["kind"], b["heading_path"]) for b in p["blocks"]] == [
        ("prose", ["Lighting"]), ("prose", ["Lighting", "Lamps"]), ("prose", ["Lighting", "Lamps"]), ("code", ["Lighting", "Lamps"]), ("prose", ["Lighting", "Lamps", "Deep"]), ("prose", ["Lighting", "Lamps", "Deep"]),
    ]
    assert p["blocks"][3]["lang"] == "py" and p["blocks"][1]["text"] == "1. first lamp\n   goes on"
    assert "weight and shade()" in p["plain"] and "**" not in p["plain"] and "x =" not in p["plain"]
    assert p["outline"] == "1. Lighting\n  1.1. Lamps\n    1.1.1. Deep"


def test_markdown_links():
    found = markdown.links(NOTE)
    assert [(x["target"], x["anchor"], x["heading"], x["kind"]) for x in found] == [("LT-0002", "the lamp", None, "wikilink"), ("rooms/hall", "here", None, "mdlink"), ("LT-0003", None, "Glow", "wikilink")]
    assert markdown.links("[a](http://x.y) [[#Here]] `[[N]]` [[A]] [[A]]") == [{"target": "A", "anchor": None, "heading": None, "kind": "wikilink"}]
    assert markdown.links("[b](a%20b.md) [c](%zz)")[0]["target"] == "a b"


@pytest.mark.parametrize("source", ["", "\n\n", "```\nnever closed", "- a\n\n- b\n", "Title\n---\ntext", "<div>\nx\n</div>", "    indented\n\n    code", "***", "[r]: http://x"])
def test_markdown_odd(source):
    p = markdown.parse(source)
    assert all(b["text"] for b in p["blocks"])


def test_chunks():
    words = " ".join(f"w{i}" for i in range(500))
    p = markdown.parse(f"# A\n\n{words}\n\nshort\n\n## B\n\nshort too\n")
    out = chunking.chunk(p["blocks"], chunking.DEFAULTS["chunking"], chunking.hashing_words)
    fine, coarse = ([c for c in out if c["strategy"] == s] for s in ("fine", "coarse"))
    assert [c["ord"] for c in fine] == list(range(len(fine))) and [c["ord"] for c in coarse] == list(range(len(coarse)))
    assert all(chunking.hashing_words(c["text"]) <= 120 for c in fine)
    assert {c["heading_path"] for c in out} == {"A", "A > B"}
    # The coarse cut's windows repeat the end of the one before.
    assert coarse[1]["text"].split()[0] in coarse[0]["text"]
    b = [[c for c in x if c["heading_path"] == "A > B"][0] for x in (fine, coarse)]
    assert b[0]["text_hash"] == b[1]["text_hash"] and b[0]["embed_text"] == "A > B\n\nshort too"


@given(st.text(alphabet="ab .\n", max_size=400), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_windows_lose_nothing(text, target):
    pieces = chunking.Windows(target, 0, chunking.approximate)(text)
    squeeze = lambda s: "".join(s.split()).replace(".", "")
    assert squeeze("".join(pieces)) == squeeze(text)


@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
@settings(max_examples=150, deadline=None)
def test_diffs_apply(a, b):
    d = diffing.diff("\n".join(a), "\n".join(b), context=50)
    lines = [x for h in d["hunks"] for x in h["lines"]]
    if d["identical"]:
        assert diffing.split_lines("\n".join(a)) == diffing.split_lines("\n".join(b))
        return
    assert [x["text"] for x in lines if x["op"] != "+"] == diffing.split_lines("\n".join(a))
    assert [x["text"] for x in lines if x["op"] != "-"] == diffing.split_lines("\n".join(b))
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
    x, y = diffing.split_lines("\n".join(a)), diffing.split_lines("\n".join(b))
    if x == a and y == b:
        assert d["removed"] == len(a) - n[-1][-1] and d["added"] == len(b) - n[-1][-1]


def test_diff_limits():
    big = "\n".join(map(str, range(5000)))
    d = diffing.diff(big, big + "\nx")
    assert d["truncated"] and d["added"] == 5001 and not d["hunks"]
    assert diffing.diff("a\r\nb\r\n", "a\nb\n")["identical"]
    assert diffing.unified(diffing.diff("a\nb\nc", "a\nx\nc")) == "@@ -1,3 +1,3 @@\n a\n-b\n+x\n c"


def test_embedder():
    v = embedding.hashed_vector("Glow glow lamp", 64)
    assert abs(np.linalg.norm(v) - 1) < 1e-6 and (embedding.hashed_vector("glow GLOW, lamp!", 64) == v).all()
    assert not embedding.hashed_vector("", 64).any()
    with pytest.raises(NotFound):
        embedding.find_model("none")
    m = embedding.find_model("hashing-64")
    a = embedding.space_id(m, {"x": 1, "y": 2})
    assert a == embedding.space_id(m, {"y": 2, "x": 1}) != embedding.space_id(m, {"x": 2, "y": 2}) and len(a) == 16


def test_neural_seam():
    seen = []

    def tokens(texts):
        seen.append(len(texts))
        hidden = np.array([[[len(t), 0.0, 1.0], [1.0, 1.0, 1.0], [9.0, 9.0, 9.0]] for t in texts])
        return hidden, np.array([[1, 1, 0]] * len(texts))

    m = embedding.Model("test-pooled", 3, "neural", query_prefix="q: ", doc_prefix="doc: ", batch=2)
    embedding.register(m, tokens)
    out = embedding.encode(["a", "bb", "ccc"], m)
    assert seen == [2, 1] and m in embedding.list_models()
    for t, v in zip(("doc: a", "doc: bb", "doc: ccc"), out, strict=True):
        want = np.array([(len(t) + 1) / 2, 0.5, 1.0])
        assert np.allclose(v, want / np.linalg.norm(want), atol=1e-6)
    assert np.allclose(embedding.encode(["x"], m, query=True)[0] * 0 + 1, 1) and abs(np.linalg.norm(embedding.encode(["x"], m, query=True)[0]) - 1) < 1e-6
    embedding.register(embedding.Model("test-bad", 4, "neural"), lambda ts: np.ones((len(ts), 3)))
    with pytest.raises(ValueError, match="shape"):
        embedding.encode(["x"], embedding.find_model("test-bad"))


def test_settings():
    c = config.apply_patch(config.defaults(), {"search.graph.boost": 0.3})
    assert config.read(c, "search.graph.boost") == 0.3 and config.read(config.DEFAULTS, "search.graph.boost") == 0.15
    for bad in ({"search.nothing": 1}, {"search.mode": 3}, {"chunking.indexCode": 1}):
        with pytest.raises(BadRequest):
            config.apply_patch(config.defaults(), bad)
    assert config.resolve_weights(c, "semantic") == (0, 1) and config.resolve_weights(c, "lexical") == (1, 0)
    for t, v in ((-1, 1), (0, 0)):
        with pytest.raises(BadRequest):
            config.resolve_weights(c, "hybrid", t, v)
    assert config.coerce("1.5") == 1.5 and config.coerce("true") is True and config.coerce("x") == "x"
    assert len(config.flatten(c)) > 25 and config.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert config.metadata_boosts(c)["tags"] == 2.5


def test_text_columns(spark):
    one = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    r = one(
        norm=T.normalise(F.lit("  a \t\r\nb  ")), toks=T.tokens(F.lit("C++ and node.js, 42 -x- .net_")), sing=F.transform(F.array(*map(F.lit, ("shaders", "boxes", "cities", "glass", "status", "bus", "days"))), T.singular),
        script=T.blocked_script(F.lit("abc\nd漢ж")), clean=T.blocked_script(F.lit("Björk — λ ° 😀")), path=T.heading_path(F.array(F.lit("A"), F.lit(" "), F.lit("B"))),
        ext=F.transform(F.array(*map(F.lit, ("http://x", "a/b", "mailto:x", "./c:d"))), T.is_external), rel=T.resolve_path(F.lit("a/b/c.md"), F.lit("../x/./y.md#z")), up=T.resolve_path(F.lit(""), F.lit("../../y")), none=T.resolve_path(F.lit("a"), F.lit("http://q")),
    )
    assert r.norm == "a\nb" and r.toks == ["c++", "and", "node.js", "net"]
    assert r.sing == ["shader", "box", "city", "glass", "status", "bus", "day"]
    assert tuple(r.script[k] for k in ("script", "char", "index", "line", "column")) == ("Han", "漢", 5, 2, 2) and r.clean is None
    assert r.path == "A > B" and r.ext == [True, False, True, False] and (r.rel, r.up, r.none) == ("a/x/y", "y", None)


def test_vector_columns(spark):
    rng = random.Random(3)
    rows = [([rng.uniform(-1, 1) for _ in range(8)], [rng.uniform(-1, 1) for _ in range(8)]) for _ in range(20)]
    got = spark.createDataFrame(rows, "a array<float>, b array<float>").select("a", "b", T.dot(F.col("a"), F.col("b")).alias("d"), T.cosine(F.col("a"), F.col("b")).alias("c"), T.l2_normalise(F.col("a")).alias("n")).collect()
    for r in got:
        a, b = np.array(r.a), np.array(r.b)
        assert abs(r.d - a @ b) < 1e-12 and abs(r.c - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12 and abs(np.linalg.norm(r.n) - 1) < 1e-12
    with pytest.raises(Exception, match="different lengths"):
        spark.range(1).select(T.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()


def test_texts_are_searched_once_for_scripts(spark):
    """every character met eleven patterns, and the search was made again for each script."""
    texts = ["", None, "Ж", "a\nbé\n xж漢", "漢", "plain λ ° 😀", "😀😀 ab\n한", "a" * 300 + "ا", "\r\n\r\nა"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", T.blocked_script(F.col("t")).alias("s"))
    assert rows.schema["s"].dataType.simpleString() == "struct<script:string,char:string,index:int,line:int,column:int>"
    got = {r.id: r.s and tuple(r.s) for r in rows.collect()}
    assert got == {0: None, 1: None, 2: ("Cyrillic", "Ж", 0, 1, 1), 3: ("Cyrillic", "ж", 7, 3, 3), 4: ("Han", "漢", 0, 1, 1), 5: None, 6: ("Hangul", "한", 6, 2, 1), 7: ("Arabic", "ا", 300, 1, 301), 8: ("Georgian", "ა", 4, 3, 1)}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count(T.BLOCKED) == 1
    every = "".join(map(chr, [*range(1, 0x370)]))
    assert not spark.range(1).select(F.lit(every).rlike("|".join(rf"\p{{Is{s}}}" for s in T.SCRIPTS))).first()[0]
    names = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", embedding.embed(F.coalesce(T.blocked_name(F.col("t")), F.lit("")), embedding.find_model("hashing-64")).alias("v"), T.blocked_name(F.col("t")).alias("s"))
    assert {r.id: r.s for r in names.collect()} == {i: s and s[0] for i, s in got.items()}
