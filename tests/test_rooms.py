"""Rooms from points and their raster steps against plain Python."""

import math
from collections import deque

import numpy as np

from atrium.operators import raster
from atrium.plans import rooms

SIDES = [(0, 1), (0, -1), (1, 0), (-1, 0)]


def _cells(df, *more):
    return {(r.row, r.col, *[r[c] for c in more]) for r in df.collect()}


def _filled(cells):
    """Cells that no walk from a corner outside reaches."""
    if not cells:
        return set()
    (r0, r1), (c0, c1) = ((min(v) - 1, max(v) + 1) for v in zip(*cells, strict=True))
    seen, todo = {(r0, c0)}, deque([(r0, c0)])
    while todo:
        r, c = todo.popleft()
        for i, j in SIDES:
            n = (r + i, c + j)
            if r0 <= n[0] <= r1 and c0 <= n[1] <= c1 and n not in cells and n not in seen:
                seen.add(n)
                todo.append(n)
    return {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)} - seen


def _flooded(region, seeds):
    label, front = dict(seeds), list(seeds)
    while front:
        reached = {}
        for r, c in front:
            for i, j in SIDES:
                n = (r + i, c + j)
                if n in region and n not in label:
                    reached[n] = min(reached.get(n, label[r, c]), label[r, c])
        label |= reached
        front = list(reached)
    return label


def _blur(values, radii, sigma):
    """Weighted sums over both axes at once."""
    ks = [[math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)] for r in radii]
    out = {}
    for (r, c), v in values.items():
        for i in range(-radii[0], radii[0] + 1):
            for j in range(-radii[1], radii[1] + 1):
                w = ks[0][i + radii[0]] / sum(ks[0]) * ks[1][j + radii[1]] / sum(ks[1])
                out[r + i, c + j] = out.get((r + i, c + j), 0.0) + w * v
    return {k: float(np.round(round(v, 6) + 1e-9)) for k, v in out.items()}


def _spread(cells, radius, cross=False):
    return {(r + i, c + j) for r, c in cells for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if not cross or abs(i) + abs(j) <= 1}


def _shrunk(cells, radius, cross=False):
    return {(r, c) for r, c in cells if all((r + i, c + j) in cells for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if not cross or abs(i) + abs(j) <= 1)}


def _grey(values):
    most = max(values.values())
    return {k: math.floor(255.0 * v / most) for k, v in values.items()}


def _rooms(points, low, high, cell, least_side=0.5):
    """One floor's rooms as {cell: number}, step by step in memory."""

    def counts(keep):
        n = {}
        for x, y, z in points:
            if keep(y):
                k = (math.floor(x / cell), math.floor(z / cell))
                n[k] = n.get(k, 0) + 1
        return n

    wall = _blur(_grey(counts(lambda y: low + 1.5 <= y < high - 0.3)), (2, 2), 1.0)
    wall = {k for k, v in wall.items() if v > 0.25 * max(wall.values())}
    wall = _shrunk(_spread(wall, 1, True), 1, True)
    ground = counts(lambda y: low <= y < high - 0.2)
    near = {k for k, v in _blur(_grey(ground), (10, 10), 2.0).items() if v > 0}
    free = _filled(_shrunk(_spread(near, 6), 6)) - wall
    free = _spread(_shrunk(free, 2), 2)
    rim = _spread(free, 1) - free
    depth = {k: math.sqrt(min((k[0] - r) ** 2 + (k[1] - c) ** 2 for r, c in rim)) for k in free}
    grey = _blur(_grey(depth), (5, 0), 10.0)
    rows, cols = ([k[i] for k in ground] for i in (0, 1))
    size = (max(rows) - min(rows) + 21) * (max(cols) - min(cols) + 21)
    image = [int(v) for v in grey.values() if v > 0]
    image += [0] * (size - len(image))
    best = None
    for t in sorted(set(image)):
        a, b = [v for v in image if v <= t], [v for v in image if v > t]
        if b:
            between = len(a) * len(b) * (sum(a) / len(a) - sum(b) / len(b)) ** 2
            if best is None or between > best[0] * (1 + 1e-12):
                best = (between, t)
    far = _filled({k for k, v in grey.items() if v > best[1]})
    parts, left = [], set(far)
    while left:
        part, todo = set(), [min(left)]
        while todo:
            k = todo.pop()
            if k in left:
                left.remove(k)
                part.add(k)
                todo += [(k[0] + i, k[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        if len(part) - (len(part) - len(_shrunk(part, 1, True))) / 2 - 1 > (least_side / cell) ** 2:
            parts.append(part & free)
    parts.sort(key=min)
    return _flooded(free, {k: i for i, p in enumerate(parts) for k in p})


def _house(rng, width, door, low, rough=0.0):
    """Two rooms of 5 by ``width`` metres with a door in the wall between."""
    out = [(x, low + 0.01 + abs(rng.normal(0, rough)), z) for x, z in rng.uniform((0, 0), (10, width), (2500, 2))]
    out += [(x, low + 2.99 - abs(rng.normal(0, rough)), z) for x, z in rng.uniform((0, 0), (10, width), (2500, 2))]
    for _ in range(8000):
        t, y = rng.uniform(0, 1), low + rng.uniform(0, 3)
        side = rng.integers(5)
        if side == 4 and not door < t * width < door + 0.8:
            out.append((5.0, y, t * width))
        elif side < 2:
            out.append((10 * t, y, [0.0, width][side]))
        elif side < 4:
            out.append(([0.0, 10.0][side - 2], y, t * width))
    return [tuple(map(float, p)) for p in out]


def test_two_rooms_of_points_equal_plain_python(spark):
    rng = np.random.default_rng(5)
    houses = {("a", 0): (_house(rng, 5, 2, 0.0), 0.0), ("a", 1): (_house(rng, 6, 1, 3.2), 3.2), ("b", 0): (_house(rng, 4, 1, 0.0), 0.0)}
    rows = [(s, *p) for (s, _), (ps, _) in houses.items() for p in ps] + [("a", float("nan"), 1.0, 1.0), ("b", None, 1.0, 1.0), ("c", 1.0, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "scene string, x double, y double, z double")
    floors = spark.createDataFrame([(s, f, low, low + 3) for (s, f), (_, low) in houses.items()], "scene string, floor_id long, low double, high double")
    got = {}
    for r in rooms.rooms_on_floors(points, floors, 0.2).collect():
        assert (r.x, r.z) == ((r.row + 0.5) * 0.2, (r.col + 0.5) * 0.2)
        got.setdefault((r.scene, r.floor_id), {})[r.row, r.col] = int(r.room_id.removeprefix(f"{r.floor_id}_"))
    for key, (ps, low) in houses.items():
        want = _rooms(ps, low, low + 3, 0.2)
        assert got[key] == want and set(want.values()) == {0, 1}
        # a room lies on its side of the wall but for the door's cells
        assert sum((x + 0.5) * 0.2 < 5 for (x, _), room in want.items() if room == 0) >= 0.95 * sum(room == 0 for room in want.values())
    assert set(got) == set(houses)


def test_rooms_of_scenes_with_unknown_floors(spark):
    rng = np.random.default_rng(6)
    rows = [("a", *p) for p in _house(rng, 5, 2, 0.0, 0.06) + _house(rng, 5, 1, 3.2, 0.06)]
    found = rooms.find_rooms(spark.createDataFrame(rows, "scene string, x double, y double, z double"), 0.2).select("floor_id", "room_id").distinct()
    assert {(r.floor_id, r.room_id) for r in found.collect()} == {(0, "0_0"), (0, "0_1"), (1, "1_0"), (1, "1_1")}


def test_no_points_have_no_rooms(spark):
    points = spark.createDataFrame([], "scene string, x double, y double, z double")
    floors = spark.createDataFrame([("a", 0, 0.0, 3.0)], "scene string, floor_id long, low double, high double")
    assert rooms.rooms_on_floors(points, floors, 0.25).columns == ["scene", "floor_id", "room_id", "row", "col", "x", "z"]
    assert rooms.rooms_on_floors(points, floors, 0.25).isEmpty()


def test_holes_are_filled_from_gaps(spark):
    rng = np.random.default_rng(7)
    pictures = {s: {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((14, 17)) < 0.6), strict=True)} for s in "xy"}
    df = spark.createDataFrame([(s, *k) for s, cells in pictures.items() for k in cells], "scene string, row long, col long")
    got = raster.fill_holes(df, ("scene",)).collect()
    for s, cells in pictures.items():
        assert {(r.row, r.col) for r in got if r.scene == s} == _filled(cells)
    assert len(got) == sum(len(_filled(c)) for c in pictures.values())


def test_floods_meet_halfway(spark):
    rng = np.random.default_rng(8)
    region = {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((25, 25)) < 0.7), strict=True)}
    seeds = {k: i for i, k in enumerate(sorted(region)[::97])}
    got = raster.flood(spark.createDataFrame(sorted(region), "row long, col long"), spark.createDataFrame([(*k, v) for k, v in seeds.items()], "row long, col long, room long"))
    assert _cells(got, "room") == {(*k, v) for k, v in _flooded(region, seeds).items()}


def test_wide_squares_go_by_axes(spark):
    cells = {(0, 0), (3, 9), (4, 20), (30, 1)}
    df = spark.createDataFrame(sorted(cells), "row long, col long")
    assert _cells(raster.dilate(df, 4)) == _spread(cells, 4)
    assert _cells(raster.close(df, 4)) == _shrunk(_spread(cells, 4), 4)
    assert _cells(raster.open_up(raster.dilate(df, 4), 4)) == _spread(cells, 4)
