"""Every survey query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from swathframe.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from swathframe.plans.views import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    cur = duck.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(plain(r[names.index(c)]) for c in got.columns) for r in cur.fetchall()), key=key)
    have = sorted((tuple(map(plain, r)) for r in got.collect()), key=key)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a == pytest.approx(b, abs=1e-5) if all(isinstance(x, (int, float)) for x in (*a, *b)) else key(a) == key(b)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
