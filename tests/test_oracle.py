"""Every registered audit query against its SQL on the smallest input."""

import os

import duckdb
import pytest

from scriptorium.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "customer part orders events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    q = duck.execute(ORACLE_SQL[name])
    cols = [d[0] for d in q.description]
    want = [tuple(r[cols.index(c)] for c in got.columns) for r in q.fetchall()]
    tidy = lambda rows: sorted(tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in map(tuple, rows)) if rows else []
    key = lambda rows: sorted(map(repr, tidy(rows) if all(None not in tuple(r) for r in rows) else [tuple(r) for r in rows]))
    assert set(cols) == set(got.columns)
    assert key(got.collect()) == key(want)
