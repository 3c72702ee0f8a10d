"""The gazetteer finds any literal, as the plain scan of each text does."""

import re

from lexigraph.operators import terms as M


def scan(body, term):
    body, term = body.lower(), term.lower()
    ends = [i.start() for i in re.finditer(f"(?={re.escape(term)})", body)]
    part = lambda c: bool(re.match("[a-z0-9]", c))
    return any(not part(body[i - 1 : i] if i else "") and not part(body[i + len(term) : i + len(term) + 1]) for i in ends)


def test_gazetteer_finds_any_literal(spark):
    terms = ["word", "two words", "state-of-the-art search", "a b c d e f g h", "one.two.three.four.five.six", "поиск", "поиск текста", "漢", "漢字", "漢字検索器", "++", "c++", "+", "—", "é", "naïve", "— so", "λ λ", "𝒳", "(?)", "zz"]
    bodies = [
        "Word by two words", "A State-of-the-Art Search engine", "state of the art search", "state-of-the-art searches", "x a b c d e f g h y", "a b c d e f g", "a b c d e f gh", "v one.two.three.four.five.six.seven", "one.two.three.four.five six",
        "Это Поиск текста", "поискx поиск1", "古漢字書", "漢字検索器", "漢字検索", "漢字検索器x 漢", "i++ and c++", "c++x", "a + b", "a+b", "wait — so", "caf é naïve", "λ λ λ", "𝒳𝒳", "so (?) what", "", "+++",
    ]
    notes = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    got = M.gazetteer_matches(notes, spark.createDataFrame([(t,) for t in [*terms, ""]], "term string")).collect()
    want = sorted((i, t) for i, b in enumerate(bodies) for t in terms if scan(b, t))
    assert sorted(map(tuple, got)) == want and {"state-of-the-art search", "a b c d e f g h", "поиск текста", "漢字検索器", "++"} <= {t for _, t in want}


def test_gazetteer_null_and_repeated_ids(spark):
    notes = spark.createDataFrame([(None, "plain and two words"), (1, "plain"), (1, "plain two words")], "id long, body string")
    got = M.gazetteer_matches(notes, spark.createDataFrame([("plain",), ("two words",), ("two words",)], "term string")).collect()
    assert len(got) == 4 and set(map(tuple, got)) == {(i, t) for i in (None, 1) for t in ("plain", "two words")}


def test_gazetteer_in_shards(spark, monkeypatch):
    """Many shards and pieces give what one of each does."""
    from lexigraph.operators import gazetteer

    terms = spark.createDataFrame([(f"w{i}",) for i in range(300)] + [(f"w{i} w{i + 1}",) for i in range(300)] + [("W7",), (None,)], "term string")
    notes = spark.createDataFrame([(n, " ".join(f"w{(n * 37 + j * j) % 310}" for j in range(60)) + " w7 w8") for n in range(20)] + [(99, None)], "id long, body string")
    want = sorted(map(tuple, gazetteer.matches(notes, terms).collect()))
    assert {(0, "w7 w8"), (0, "w7"), (0, "W7")} <= set(want)
    for name, value in (("WORD_BYTES", 400), ("OTHER_BYTES", 700), ("PIECE", 10)):
        monkeypatch.setattr(gazetteer, name, value)
    assert sorted(map(tuple, gazetteer.matches(notes, terms).collect())) == want
