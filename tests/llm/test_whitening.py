"""Whitening against numpy's own covariance and eigenvectors, and exact sums."""

import math

import numpy as np
import pytest

from lexigraph.llm import queries as Q
from lexigraph.llm import whitening
from lexigraph.llm.common import table


def by_hand(vectors):
    """What the contract asks for, from all vectors at once."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    centred = np.array([[a - b / n for a, b in zip(r, s, strict=True)] for r in x])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    return deviation, centred, e[::-1], u[:, ::-1], np.trace(v)


def test_query(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in table(spark, sf_dir, "embeddings").collect()}
    ids = sorted(vectors)
    deviation, centred, e, u, trace = by_hand([vectors[i] for i in ids])
    rows = Q.op12_embedding_whitening(spark, sf_dir).collect()
    assert len(rows) == 8 * len(ids)
    got = {(r.vec_id, r.component): r for r in rows}
    assert {r.n for r in rows} == {len(ids)} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    for k in range(8):
        mine = np.array([got[i, k + 1].whitened for i in ids])
        want = centred @ u[:, k] / math.sqrt(e[k])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert all(math.isclose(got[i, k + 1].explained, e[k] / trace, rel_tol=1e-10) for i in ids)
    assert [got[i, 1].deviation for i in ids] == deviation


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 130])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    for m in (a @ a.T, a + a.T, np.diag(np.arange(n, dtype=float)), np.ones((n, n)), np.zeros((n, n)), 1e12 * np.eye(n)):
        values, vectors = whitening.symmetric_qr(m)
        scale = max(1.0, np.abs(m).max() * n)
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-13 * scale)
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
        assert np.abs(m @ vectors - vectors * values).max() < 1e-12 * scale


def test_merging_is_adding():
    x = np.random.default_rng(3).normal(size=(500, 5)) + 1e6
    whole, parts = whitening.Moments.empty(5), whitening.Moments.empty(5)
    for begin in range(0, 500, 77):
        part = whitening.Moments.empty(5)
        for row in x[begin : begin + 77]:
            part.add(row)
            whole.add(row)
        parts.merge(part)
    want = np.cov(x.T, bias=True)
    assert parts.n == whole.n == 500 and np.allclose(whole.covariance(), want, atol=1e-6) and np.allclose(parts.covariance(), want, atol=1e-6)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -1.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [-inf, 1.0]), (7, [3.0, 0.25]), (8, [1.0, 2.0, 3.0]), (9, []), (10, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as x", "2 as n", "3 as part", "4 as id", "5 as component")
    out = whitening.whiten(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in out) == sorted((i is None, i or 0, c) for i in (1, 1, None, 7) for c in (1, 2))
    assert {r.n for r in out} == {4} and out[0].identity_error < 1e-12
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 3")).count() == 0
    # One direction only, and none at all: such components whiten to 0.
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(20)], "vec_id long, embedding array<double>")
    found = whitening.whiten(line).collect()
    assert all(abs(r.whitened) < 2 and (r.component == 1 or r.whitened == 0) for r in found) and found[0].identity_error < 1e-12
    assert {(r.whitened, r.deviation, r.explained) for r in whitening.whiten(line.where("vec_id = 3")).collect()} == {(0.0, 0, 0.0)}


def test_deviations_are_exact():
    x = np.array([[100_000, 3], [0, 5]])
    for n in (7, 10**6, 10**9, 10**13):
        s = np.array([n * 100_000 - 3, 4 * n])
        want = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
        assert whitening.deviations(x, s, n) == [w if w < 1 << 63 else None for w in want]
