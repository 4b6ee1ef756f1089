"""Top-k by cell bounds against brute force."""

import numpy as np
import pytest

from atrium.operators import cells


def _table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<double>")


def _asked(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id long, query array<double>")


def _dot(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += float(x) * float(y)
    return total


def _brute(vectors, asked, k):
    return {(q, r + 1): (i, s) for q, v in enumerate(asked) for r, (s, i) in enumerate(sorted(((_dot(x, v), i) for i, x in enumerate(vectors)), key=lambda t: (-t[0], t[1]))[:k])}


@pytest.mark.parametrize("shape", ["spread", "clustered", "lengths", "equal"])
def test_top_k_equals_brute_force(spark, shape):
    rng = np.random.default_rng(len(shape))
    v = rng.normal(size=(400, 6))
    if shape == "clustered":
        v = rng.normal(size=(10, 6))[rng.integers(0, 10, 400)] * 5 + v * 0.05
    if shape == "lengths":
        v *= 10 ** rng.uniform(-3, 3, (400, 1))
    if shape == "equal":
        v = np.round(v[rng.integers(0, 30, 400)])
    asked = np.concatenate([rng.normal(size=(7, 6)), np.zeros((1, 6)), v[:2]])
    index = cells.build(_table(spark, v), "id", cells=12, sample=100)
    assert index.members.count() == 400
    got = cells.top_k(index, _asked(spark, asked), 9).collect()
    assert {(r.query_id, r["rank"]): (r.id, r.sim) for r in got} == _brute(v, asked, 9)
    if shape == "clustered":
        assert np.mean([r.scored for r in got if r.query_id != 7]) < 200  # less than half of all rows


def test_odd_vectors_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    v = [[1, 0], None, [nan, 1], [0, inf], [None, 1], [1], [1, 2, 3], [0, 0], [1, 0], [], [3, -1]]
    index = cells.build(_table(spark, v), "id", cells=4)
    got = cells.top_k(index, _asked(spark, [[1, 1], [nan, 0], [1], []]), 20).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.sim, r.scored) for r in got) == [(0, 1, 10, 2.0, 4), (0, 2, 0, 1.0, 4), (0, 3, 8, 1.0, 4), (0, 4, 7, 0.0, 4)]
    empty = cells.build(_table(spark, [None, []]), "id")
    assert cells.top_k(empty, _asked(spark, [[1, 1]]), 3).count() == 0
    assert cells.top_k(index, _asked(spark, [[1, 1]]).limit(0), 3).count() == 0
