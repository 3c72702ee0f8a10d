"""Every registered query against its SQL, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from lexigraph.catalogue import FIXED, FLAGSHIP, ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted([*ORACLE_SQL, *FIXED]))
def test_against_sql(spark, sf_dir, duck, name):
    query, sql = FIXED[name] if name in FIXED else (QUERIES[name], ORACLE_SQL[name])
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    rows = lambda rs: sorted(repr([plain(x) for x in r]) for r in rs)
    assert rows(df.select(*[f"`{n}`" for n in names]).collect()) == rows(want.fetchall())


def test_flagship_adds_up(spark, sf_dir):
    rows = QUERIES[FLAGSHIP](spark, sf_dir).collect()
    assert rows and len({r.qid for r in rows}) > 10
    for r in rows:
        w = r.why
        assert abs(r.score - (w.text + w.vector + w.meta + w.multi_chunk + w.graph)) < 2e-6
    for q in {r.qid for r in rows}:
        mine = sorted((r for r in rows if r.qid == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
        assert all((a.score, b.id) >= (b.score, a.id) or a.score > b.score - 1e-6 for a, b in zip(mine, mine[1:], strict=False))
