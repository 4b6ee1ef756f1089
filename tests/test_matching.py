"""Matching by components against brute force over all assignments."""

import itertools
import math
import random

import numpy as np
import pytest

from atrium.operators import matching


def _best(table):
    """The largest sum over all assignments of the smaller side."""
    table = table if table.shape[0] <= table.shape[1] else table.T
    n, m = table.shape
    return max((sum(table[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)), default=0.0)


@pytest.mark.parametrize("seed", range(60))
def test_heaviest_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2)
    table = np.where(rng.uniform(size=(n, m)) < 0.5, rng.integers(1, 6, (n, m)) / 5, 0.0)  # few values: ties are common
    links = [[(j, float(table[i, j])) for j in range(m) if table[i, j] > 0] for i in range(n)]
    got = matching.heaviest(links)
    assert len(set(got.values())) == len(got) and all(table[i, j] > 0 for j, i in got.items())
    assert math.isclose(sum(table[i, j] for j, i in got.items()), _best(table), abs_tol=1e-12)


def test_scenes_with_equal_ids_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, tables = [], {}
    for scene in range(12):
        n, m = rng.integers(2, 7, 2)
        table = np.where(rng.uniform(size=(n, m)) < 0.35, rng.integers(1, 9, (n, m)) / 8, 0.0)
        tables[scene] = table
        rows += [(scene, i, j, float(table[i, j])) for i in range(n) for j in range(m)]
    got = matching.match(spark.createDataFrame(rows, "scene int, a long, b long, score double"), ("scene",)).collect()
    for scene, table in tables.items():
        own = [r for r in got if r.scene == scene]
        assert len({r.a for r in own}) == len({r.b for r in own}) == len(own) == min(table.shape)
        assert all(r.score == table[r.a, r.b] or r.score == 0 for r in own)
        assert math.isclose(sum(r.score for r in own), _best(table), abs_tol=1e-12)


def test_odd_scores_and_no_keys(spark):
    nan = float("nan")
    rows = [("p", 1, 0.5), ("p", 1, 0.7), ("p", 2, 0.9), ("q", 2, -3.0), ("q", 3, nan), ("r", 3, None), ("r", 1, 0.1), (None, 1, 9.0), ("s", None, 9.0)]
    got = {(r.a, r.b): r.score for r in matching.match(spark.createDataFrame(rows, "a string, b int, score double"), ()).collect()}
    # p takes 2 and r takes 1 (0.9 + 0.1); q and 3 are left over
    assert got == {("p", 2): 0.9, ("r", 1): 0.1, ("q", 3): 0.0}
    assert matching.match(spark.createDataFrame([], "scene int, a long, b long, score double"), ("scene",)).count() == 0


def test_null_keys_are_one_scene(spark):
    rows = [(None, 1, 1, 0.5), (None, 2, 1, 0.9), (None, 1, 2, 0.2), (7, 1, 1, 0.3)]
    got = {(r.scene, r.a, r.b): r.score for r in matching.match(spark.createDataFrame(rows, "scene int, a long, b long, score double"), ("scene",)).collect()}
    assert got == {(None, 2, 1): 0.9, (None, 1, 2): 0.2, (7, 1, 1): 0.3}


def test_one_large_component_is_optimal(spark):
    """2,000 nodes a side with 10 links each: prices of an optimal matching bound every other one."""
    r = random.Random(4)
    n = 2000
    planted = r.sample(range(n), n)
    rows = {(i, planted[i]): 1.0 for i in range(n)}
    for i in range(n):
        for _ in range(9):
            rows.setdefault((i, r.randrange(n)), r.random() * 0.99)
    got = matching.match(spark.createDataFrame([(1, i, j, s) for (i, j), s in rows.items()], "scene int, a long, b long, score double"), ("scene",))
    assert {(x.a, x.b) for x in got.collect()} == set(enumerate(planted))
