"""The likeness of a text's halves reads every word."""

from lexigraph.catalogue import QUERIES


def test_every_word_counts(spark, tmp_path):
    texts = ["a b c d e f g h i j k l", "a b c d e f g h i j k A", "one", "x X", "a b a c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.likeness for r in QUERIES["set6_jaccard"](spark, str(tmp_path)).collect()}
    assert got == {0: 0.0, 1: round(1 / 11, 6), 2: 0.0, 3: 1.0, 4: round(1 / 3, 6)}
