"""Fill-in-the-middle against the definition, for chunks of any size."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexigraph.llm import fim

ODD = [(None, "x\ny"), (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "a" * 100), (6, "a\n" * 50), (6, "a\n" * 50), (7, "one\n<S>\ntwo"), (8, "<S"), (9, "été\r\n😀\n"), (10, "line of words\n" * 40_000)]


def by_definition(doc, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(x in text for x in fim.MARKERS) or h[2] % 100 >= rate:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 2, 3, 16, fim.CHUNK])
def test_by_definition(spark, chunk):
    rng = random.Random(chunk)
    rows = [(i, "".join(rng.choice("ab\n\né😀<PSM>") for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [r for r in ODD if chunk > 3 or len(r[1] or "") < 1000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'r' as raw", "'d' as digest", "2 as doc", "3 as before", "'f' as form", "'p' as prefix")
    out = fim.rearrange(docs, chunk=chunk)
    found = out.withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    assert [tuple(r)[:6] for r in found] == [by_definition(*r) for r in rows]
    assert [r.back for r in found] == [t or "" for _, t in rows]


def test_rates(spark):
    rows = [(i, "a\nb\nc") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = fim.rearrange(docs, rate=40, spm_rate=10).collect()
    assert [tuple(r) for r in found] == [by_definition(*r, 40, 10) for r in rows]
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_no_rows(spark):
    assert fim.rearrange(spark.createDataFrame([], "doc_id long, text string")).count() == 0
