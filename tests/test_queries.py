"""Every query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from atrium.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
SQL = oracle_sql()


def _key(row):
    return tuple((v is not None, str(type(v)) if isinstance(v, str) else "", v if v is not None else 0) for v in row)


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got = queries()[name](spark, DATA)
    columns = sorted(got.columns)
    ours = [tuple(_plain(r[c]) for c in columns) for r in got.collect()]
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    cur = db.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = [tuple(_plain(float(r[i]) if r[i].__class__.__name__ == "Decimal" else r[i]) for i in order) for r in cur.fetchall()]
    assert len(ours) == len(theirs) > 0  # a comparison of nothing shows nothing
    for a, b in zip(sorted(ours, key=_key), sorted(theirs, key=_key), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)), (name, a, b)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_query_finds_rows(spark, name):
    """Those without SQL; test_operators.py holds their operators against plain Python."""
    assert not queries()[name](spark, DATA).isEmpty()
