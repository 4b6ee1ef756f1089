"""Queries that take point ids apart, on keys whose point ids don't fit a double's 53 bits."""

import os
import shutil

import duckdb
import pytest

from atrium.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """sf0.001 with order keys shifted by 8,000,000; every second line is of supplier 9,999, the last that a point id has digits for."""
    folder = tmp_path_factory.mktemp("large")
    for f in os.listdir(SMALL):
        shutil.copyfile(f"{SMALL}/{f}", folder / f)
    shifted = "l_orderkey + 8000000 AS l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 9999 ELSE l_suppkey END AS l_suppkey"
    duckdb.sql(f"COPY (SELECT * REPLACE ({shifted}) FROM '{SMALL}/lineitem.parquet') TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["e13_topology", "e2_threshold_sweep", "e3_score_matrix"])
def test_large_ids_equal_sql(spark, large, name):
    got = queries()[name](spark, large)
    db = duckdb.connect()
    for f in os.listdir(large):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{large}/{f}'")
    want = db.sql(oracle_sql()[name])
    plain = lambda rows: sorted(tuple(None if v is None else round(float(v), 5) for v in r) for r in rows)
    assert plain([r[c] for c in want.columns] for r in got.collect()) == plain(want.fetchall())
