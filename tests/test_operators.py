"""Operators against plain Python on small seeded fixtures."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from atrium.functions import geometry, phrases, vector
from atrium.operators import clustering, graph, matching, metrics, ordered, ranking, raster, spatial
from atrium.plans import evaluation, navigation, scene, search
from atrium.session import cut


def _points(spark, xyz, **extra):
    rows = [(i, *map(float, p), *[v[i] for v in extra.values()]) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, ["point_id", "x", "y", "z", *extra])


def test_nearest_is_exact_with_ties(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-20, 20, (60, 3)), np.concatenate([rng.uniform(-20, 20, (40, 3)), [[100, 100, 100], [100, 100, 100]]])
    a = np.concatenate([a, [[101, 100, 100]]])
    left, right = _points(spark, a), _points(spark, b).withColumnRenamed("point_id", "map_id")
    got = {r.point_id: (r.map_id, r.distance) for r in spatial.nearest(left, right, "point_id", "map_id", 1.0).collect()}
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(d.argmin(1).tolist()))
    assert got[60] == (40, 1.0)


def test_box_iou_of_known_boxes(spark):
    boxes = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0), (2, 0.5, 1.5, 0.0, 1.0, 0.0, 1.0), (3, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0), (4, 5.0, 6.0, 5.0, 6.0, 5.0, 6.0)], ["id", "x0", "x1", "y0", "y1", "z0", "z1"])
    got = {(r.a, r.b): round(r.iou, 9) for r in spatial.iou_pairs(boxes, "id", 0.4, 0.0).collect()}
    assert got == {(1, 2): round(1 / 3, 9), (1, 3): 1.0, (2, 3): round(1 / 3, 9)}


def test_overlap_is_symmetric_and_bounded(spark):
    rng = np.random.default_rng(2)
    xyz, seg = rng.uniform(0, 3, (80, 3)), [i % 2 for i in range(80)]
    p = _points(spark, xyz, segment=seg)
    pairs = spark.createDataFrame([(0, 1), (1, 0)], "a long, b long")
    got = {(r.a, r.b): r.overlap for r in spatial.overlap_ratio(p, pairs, "segment", "point_id", 0.5).collect()}
    near = np.linalg.norm(xyz[0::2][:, None] - xyz[1::2][None], axis=2) < 0.5
    assert got[0, 1] == got[1, 0] == max(near.any(1).mean(), near.any(0).mean())


def test_dbscan_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.normal(0, 0.3, (40, 3)), rng.normal(5, 0.3, (30, 3)), rng.uniform(-20, 20, (10, 3))])
    got = {r.point_id: r.cluster for r in clustering.dbscan(_points(spark, xyz), "point_id", 0.5, 4).collect()}
    near = np.linalg.norm(xyz[:, None] - xyz[None], axis=2) <= 0.5
    core = near.sum(1) >= 4
    label = {}
    for i in np.flatnonzero(core):
        if i not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in label:
                    label[j] = int(i)
                    todo += np.flatnonzero(near[j] & core).tolist()
    want = {i: label.get(i, label.get(next(iter(np.flatnonzero(near[i] & core)), -1))) for i in range(len(xyz))}
    assert got == want


@pytest.mark.parametrize("shape", [(3, 4), (4, 3), (5, 5)])
def test_matching_is_maximal(spark, shape):
    m = np.random.default_rng(sum(shape)).uniform(0, 1, shape)
    scores = spark.createDataFrame([(0, i, j, float(m[i, j])) for i in range(shape[0]) for j in range(shape[1])], ["scene", "a", "b", "score"])
    got = matching.match(scores, ("scene",)).collect()
    small, big = min(shape), max(shape)
    t = m if shape[0] <= shape[1] else m.T
    best = max(sum(t[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
    assert len(got) == small and abs(sum(r.score for r in got) - best) < 1e-12


def test_perfect_prediction_scores_one(spark):
    conf = metrics.confusion(spark.createDataFrame([(i % 3, i % 3) for i in range(9)], ["p", "g"]), "p", "g")
    assert tuple(metrics.segmentation_summary(conf).head()) == (1.0, 1.0, 1.0, 1.0)


def test_components_trim_and_chains(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0), (4, 6, 1.0), (8, 9, 1.0)], ["src", "dst", "dist"])
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)], ["id"])
    got = {r.id: r.component for r in graph.components(nodes, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 8, 9: 8}
    assert graph.trim(edges).count() == 0
    chains = {(r.src, r.dst, r.dist) for r in graph.contract_chains(edges.where("src < 8")).collect()}
    assert chains == {(1, 4, 3.0), (4, 5, 1.0), (4, 6, 1.0)}
    paths = {r.id: r.dist for r in graph.shortest_paths(edges, nodes.where("id = 1")).collect()}
    assert paths == {1: 0.0, 2: 1.0, 3: 2.0, 4: 3.0, 5: 4.0, 6: 4.0}


def test_two_rooms_joined_by_a_door(spark):
    cells = [(r, c) for r in range(20) for c in range(20)] + [(r, c) for r in range(20) for c in range(25, 45)] + [(r, c) for r in (9, 10) for c in range(20, 25)]
    rooms = raster.segment_rooms(spark.createDataFrame(cells, ["row", "col"]), 4.0)
    assert rooms.count() == len(cells) and rooms.select("room").distinct().count() == 2


def test_distance_to_walls(spark):
    got = {(r.row, r.col): r.d2 for r in raster.nearest_wall(spark.createDataFrame([(r, c) for r in range(7) for c in range(9)], ["row", "col"])).collect()}
    assert got == {(r, c): min(r + 1, 7 - r, c + 1, 9 - c) ** 2 for r in range(7) for c in range(9)}


def test_floors_of_slabs_and_single_peak(spark):
    peaks = spark.createDataFrame([("a", 0.1, 9.0), ("a", 2.6, 8.0), ("a", 3.0, 7.0), ("a", 5.6, 9.0), ("b", 1.0, 3.0)], ["scene", "height", "n"])
    ends = spark.createDataFrame([("a", 0.0, 6.0), ("b", 0.5, 2.0)], ["scene", "lo", "hi"])
    got = {(r.scene, r.floor): (round(r.low, 6), round(r.high, 6)) for r in ordered.floor_intervals(peaks, ends).collect()}
    assert got == {("a", 0): (0.05, 2.6), ("a", 1): (3.0, 5.8), ("b", 0): (0.5, 2.0)}


def test_rooms_without_camera_get_the_nearest_inside(spark):
    cameras = spark.createDataFrame([(1, 0.0, 1.0, 0.0), (2, 0.5, 1.0, 0.0), (3, 100.0, 9.0, 0.0)], ["frame_id", "x", "y", "z"])
    rooms = spark.createDataFrame([("r1", 0.0, 0.0), ("r2", 100.0, 0.0)], ["room_id", "x", "z"])
    got = {(r.room_id, r.frame_id) for r in scene.assign_cameras(cameras, rooms, 0.0, 5.0).collect()}
    assert got == {("r1", 1), ("r1", 2), ("r2", 2)}


def test_phrases(spark):
    texts = [("chair",), ("chair in the kitchen",), ("chair on floor 2",), ("chair in the living room on floor 1",), ("chair in region hall on the second floor",), ("",), (None,)]
    got = [(r.object_name, r.room_name, r.floor_no) for r in search.parse(spark.createDataFrame(texts, "query string")).collect()]
    assert got == [("chair", None, None), ("chair", "kitchen", None), ("chair", None, 2), ("chair", "living room", 1), ("chair", "hall", 2), (None, None, None), (None, None, None)]
    assert spark.range(1).select(phrases.parent_id(F.lit("0_1_10"))).head()[0] == "0_1"


def test_vectors_and_votes(spark):
    one = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], ["a", "zero"]).select(vector.norm("a"), vector.normalize("zero"), vector.cosine("a", "zero")).head()
    assert tuple(one) == (5.0, [0.0, 0.0], 0.0)
    votes = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], ["k", "label"])
    assert {(r.k, r.label) for r in ranking.majority(votes, ("k",), "label").collect()} == {(1, "a"), (2, "c")}


def test_pose_text_and_projection(spark):
    pose = geometry.flip_yz(geometry.pose_values(F.lit("1 0 0 5 0 1 0 6 0 0 1 7 0 0 0 1")))
    got = spark.range(1).select(*geometry.position(pose), *geometry.transform(pose, F.lit(1.0), F.lit(2.0), F.lit(3.0))).head()
    assert tuple(got) == (5.0, 6.0, 7.0, 6.0, 4.0, 4.0)


def test_k_nearest_has_all_neighbours_however_far(spark):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(0, 5, (30, 3)), np.concatenate([rng.uniform(0, 5, (20, 3)), [[400.0, 0, 0]]])
    a = np.concatenate([a, [[900.0, 0, 0]]])
    got = {}
    for r in spatial.k_nearest(_points(spark, a), _points(spark, b).withColumnRenamed("point_id", "map_id"), "point_id", "map_id", 4, 0.5).collect():
        got.setdefault(r.point_id, {})[r["rank"]] = r.right.map_id
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {i: np.lexsort((np.arange(21), d[i]))[:4].tolist() for i in range(31)}
    few = spatial.k_nearest(_points(spark, a), _points(spark, b[:2]).withColumnRenamed("point_id", "map_id"), "point_id", "map_id", 4, 0.5)
    assert few.count() == 62


def test_boxes_of_any_size_meet(spark):
    rng = np.random.default_rng(5)
    low, size = rng.uniform(-30, 30, (60, 3)), 10 ** rng.uniform(-2, 2, (60, 1)) * rng.uniform(0.5, 1, (60, 3))
    rows = [(i, i % 2, *[float(v) for a in range(3) for v in (low[i, a], low[i, a] + size[i, a])]) for i in range(60)]
    boxes = spark.createDataFrame(rows, ["id", "scene", "x0", "x1", "y0", "y1", "z0", "z1"])
    inter = np.prod(np.clip(np.minimum(low[:, None] + size[:, None], low + size) - np.maximum(low[:, None], low), 0, None), axis=2)
    volume = size.prod(1)
    iou = inter / (volume[:, None] + volume - inter)
    want = {(i, j) for i in range(60) for j in range(60) if i < j and iou[i, j] > 0}
    assert {(r.a, r.b) for r in spatial.iou_pairs(boxes, "id", 0.5, 0.0).collect()} == want
    one = boxes.withColumnRenamed("id", "a"), boxes.withColumnRenamed("id", "b")
    got = {(r.scene, r.a, r.b): r.iou for r in spatial.box_pairs(*one, "a", "b", 0.5, 0.0, ("scene",)).collect()}
    assert set(got) == {(i % 2, i, j) for i in range(60) for j in range(60) if i % 2 == j % 2 and iou[i, j] > 0}
    assert all(abs(v - iou[i, j]) < 1e-9 for (_, i, j), v in got.items())


def _brute_merge(clouds, iou, overlap, radius):
    """Names of merged segments: the least of what boxes and points connect."""
    names = sorted(clouds)
    boxes = {k: (v.min(0), v.max(0)) for k, v in clouds.items()}
    group = {k: k for k in names}
    for a, b in itertools.combinations(names, 2):
        (la, ha), (lb, hb) = boxes[a], boxes[b]
        inter = np.clip(np.minimum(ha, hb) - np.maximum(la, lb), 0, None).prod()
        if inter / ((ha - la).prod() + (hb - lb).prod() - inter) > iou:
            near = np.linalg.norm(clouds[a][:, None] - clouds[b][None], axis=2) < radius
            if max(near.any(1).mean(), near.any(0).mean()) > overlap:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    return group


def _segments(spark, clouds, **extra):
    rows = [(k, 1000 * k + i, *map(float, p), *[v[k] for v in extra.values()]) for k, c in clouds.items() for i, p in enumerate(c)]
    return spark.createDataFrame(rows, ["segment", "point_id", "x", "y", "z", *extra])


def test_merged_masks_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.uniform(0, 6, (12, 3))
    clouds = {i: centres[i % 7] + rng.normal(0, 0.5, (30, 3)) for i in range(12)}
    want = _brute_merge(clouds, 0.1, 0.3, 0.4)
    got = clustering.merge_masks(_segments(spark, clouds), "segment", "point_id", 0.1, 0.3, 0.4, 1e-6)
    named = {r.point_id // 1000: r.segment for r in got.collect()}
    assert named == want and len(set(want.values())) < 12
    names = spark.createDataFrame([(i, i % 2, "chair") for i in range(12)], "segment long, room_id long, name string")
    same = {r.segment: r.merged_id for r in clustering.merge_same_name(_segments(spark, clouds), names, "segment", "point_id", 0.4, 0.3).collect()}
    for room in (0, 1):
        part = {k: v for k, v in clouds.items() if k % 2 == room}
        grown = {k: np.concatenate([v, [v.min(0) - 0.4, v.max(0) + 0.4]]) for k, v in part.items()}
        boxes = {k: (v.min(0), v.max(0)) for k, v in grown.items()}
        group = {k: k for k in part}
        for a, b in itertools.combinations(sorted(part), 2):
            near = np.linalg.norm(part[a][:, None] - part[b][None], axis=2) < 0.4
            if (np.minimum(boxes[a][1], boxes[b][1]) > np.maximum(boxes[a][0], boxes[b][0])).all() and max(near.any(1).mean(), near.any(0).mean()) > 0.3:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
        assert {k: v for k, v in same.items() if k % 2 == room} == group


@pytest.mark.parametrize("frames", [1, 2, 5])
def test_frame_merges_equal_brute_force(spark, frames):
    rng = np.random.default_rng(7)
    centres = rng.uniform(0, 5, (3, 3))
    clouds = {10 * f + k: centres[k] + rng.normal(0, 0.4, (25, 3)) for f in range(frames) for k in range(3)}
    # frames have gaps in their numbers
    p = _segments(spark, clouds, frame={k: 7 * (k // 10) + k // 10 % 2 for k in clouds})
    threshold, decay, iou, radius = 0.55, 0.2, 0.05, 0.4

    def merged(parts, limit):
        group = _brute_merge(parts, iou, limit, radius)
        return {g: np.concatenate([parts[k] for k in sorted(parts) if group[k] == g]) for g in sorted(set(group.values()))}

    level, limit = [{k: v for k, v in clouds.items() if k // 10 == f} for f in range(frames)], threshold
    while len(level) > 1:
        level = [merged({**level[i], **(level[i + 1] if i + 1 < len(level) else {})}, limit) for i in range(0, len(level), 2)]
        if len(level) > 1:
            limit -= decay * (len(level) - 2) / max(1, len(level) - 1)
    got = clustering.hierarchical_merge(p, "frame", "segment", "point_id", threshold, decay, iou, radius, 1e-6)
    assert {r.segment: r["count"] for r in got.groupBy("segment").count().collect()} == {k: len(v) for k, v in merged(level[0], 0.75).items()}
    now = {k: v for k, v in clouds.items() if k < 10}
    for f in range(1, frames):
        now = merged({**now, **{k: v for k, v in clouds.items() if k // 10 == f}}, threshold)
    got = clustering.sequential_merge(p, "frame", "segment", "point_id", iou, threshold, radius, 1e-6)
    assert {r.segment: r["count"] for r in got.groupBy("segment").count().collect()} == {k: len(v) for k, v in merged(now, threshold).items()}


def test_mask_features_are_means_of_largest_clusters(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3, 16))
    rows, item = [], 0
    for m in range(4):
        for k in range(3):
            for _ in range([9, 5, 2][k] if m else 2):
                rows.append((m, item, (base[(m + k) % 3] * rng.uniform(1, 3) + rng.normal(0, 0.01, 16)).tolist()))
                item += 1
    got = {r.mask: r.embedding for r in clustering.mask_features(spark.createDataFrame(rows, "mask long, item long, embedding array<double>"), "mask", "item", 0.01, 4).collect()}
    for m in range(4):
        x = np.array([v for k, _, v in rows if k == m])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = unit @ unit.T >= 1 - 0.01
        core = near.sum(1) >= 4
        label = [min((j for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))]
        assert all(near[i, j] == (label[i] == label[j]) for i in np.flatnonzero(core) for j in np.flatnonzero(core))
        sizes = {c: label.count(c) for c in set(label) - {-1}}
        keep = [i for i in range(len(x)) if not sizes or label[i] == min(sizes, key=lambda c: (-sizes[c], c))]
        assert np.allclose(got[m], x[keep].mean(0))


def test_view_representatives_are_medoids(spark):
    rng = np.random.default_rng(9)
    rows = [(0, i, rng.normal(size=4).tolist()) for i in range(3)] + [(1, 100 + i, (np.eye(4)[i % 2] * 9 + rng.normal(0, 0.1, 4)).tolist()) for i in range(20)]
    got = clustering.view_representatives(spark.createDataFrame(rows, "room long, view long, embedding array<double>"), "room", "view", 3).collect()
    assert {r["view"] for r in got if r.room == 0} == {0, 1, 2}
    best = [r["view"] for r in got if r.room == 1]
    assert len(set(best)) == len(best) <= 3 and {v % 2 for v in best} == {0, 1}
    x = {v: np.array(e) for k, v, e in rows if k == 1}
    # each is the member of its cluster that is nearest in direction to the cluster's mean
    centres = {v: x[v] for v in best}
    for v in best:
        members = [u for u in x if min(centres, key=lambda c: np.linalg.norm(x[u] - centres[c])) == v]
        assert max(members, key=lambda u: x[u] @ np.mean([x[w] for w in members], axis=0)) in best


def test_paths_are_resampled_by_distance_walked(spark):
    rng = np.random.default_rng(10)
    rows = [(p, i, *rng.uniform(0, 3, 3).tolist()) for p in range(4) for i in rng.permutation(300).tolist()]
    got = {(r.path, r.i) for r in ordered.resample_path(spark.createDataFrame(rows, "path long, i long, x double, y double, z double").repartition(5), "i", 5.0).collect()}
    want = set()
    for p in range(4):
        own = sorted((i, np.array(xyz)) for q, i, *xyz in rows if q == p)
        walked, last = 0.0, own[0][1]
        want.add((p, own[0][0]))
        for i, at in own[1:]:
            walked, last = walked + np.linalg.norm(at - last), at
            if walked > 5.0:
                want.add((p, i))
                walked = 0.0
    assert got == want


def _brute_cells(cells, diagonal=True):
    cells, out = set(cells), {}
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (diagonal or not (i and j))]
    for c in cells:
        if c not in out:
            todo, seen = [c], {c}
            while todo:
                r, k = todo.pop()
                for i, j in steps:
                    n = (r + i, k + j)
                    if n in cells and n not in seen:
                        seen.add(n)
                        todo.append(n)
            out |= {n: frozenset(seen) for n in seen}
    return out


@pytest.mark.parametrize("diagonal", [True, False])
def test_cell_components_of_many_scenes(spark, diagonal):
    rng = np.random.default_rng(11)
    scenes = [7, 18161, *range(100, 105)]
    rows = [(s, *map(int, c)) for s in scenes for c in {tuple(x) for x in rng.integers(-6, 6, (50, 2)).tolist()}]
    got = raster.cell_components(spark.createDataFrame(rows, "scene long, row long, col long"), ("scene",), diagonal).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.component, set()).add((r.scene, r.row, r.col))
    want = {frozenset((s, *c) for c in part) for s in scenes for part in _brute_cells([(a, b) for q, a, b in rows if q == s], diagonal).values()}
    assert {frozenset(p) for p in parts.values()} == want


def test_free_cells_and_medial_axis(spark):
    rng = np.random.default_rng(12)
    region = {(int(a), int(b)) for a, b in rng.integers(0, 14, (120, 2))}
    seen, obstacles = {(3, 3), (20, 20)}, {(int(a), int(b)) for a, b in rng.integers(0, 14, (25, 2))}
    frame = lambda cells: spark.createDataFrame(sorted(cells), "row long, col long")
    got = {(r.row, r.col) for r in raster.free_cells(frame(region), frame(seen), frame(obstacles), 2).collect()}
    discs = {(r + i, c + j) for r, c in seen for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4}
    parts = set(_brute_cells((region | discs) - obstacles).values())
    most = max(map(len, parts))
    assert got in [set(p) for p in parts if len(p) == most]
    # a corridor's axis lies in its middle
    corridor = frame({(r, c) for r in range(5) for c in range(30)})
    walls = raster.nearest_wall(corridor)
    edges = raster.medial_edges(walls, 4.0).collect()
    rows = {int(x.split(":")[0]) for e in edges for x in (e.src, e.dst)}
    cells = {tuple(map(int, x.split(":"))) for e in edges for x in (e.src, e.dst)}
    assert edges and rows <= {1, 2, 3} and {c for _, c in cells} >= set(range(3, 27))


def test_chains_as_paths_and_their_samples(spark):
    # a star of three arms of 40, 7 and 1 steps, a cycle, and a path of two nodes
    edges = [(0, 1, 1.5), *[(i, i + 1, 0.5 + i % 3) for i in range(1, 40)], (0, 100, 1.0), *[(i, i + 1, 1.0) for i in range(100, 106)], (0, 200, 2.0), *[(300 + i, 300 + (i + 1) % 5, 1.0) for i in range(5)], (400, 401, 3.0)]
    rng = np.random.default_rng(13)
    mixed = [(a, b, d) if rng.random() < 0.5 else (b, a, d) for a, b, d in edges]
    table = spark.createDataFrame(mixed, "src long, dst long, dist double")
    got = {}
    for r in graph.chain_paths(table).collect():
        got.setdefault((r.start, r.first), []).append((r.at, r.node, r.ends))
    arm = [(0, 1.5)] + [(i, 0.5 + i % 3) for i in range(1, 40)]
    far = np.cumsum([d for _, d in arm]).tolist()
    assert sorted(got) == [(0, 1), (0, 100)]
    assert sorted(got[0, 1]) == [(far[i], i + 1, i == 39) for i in range(40)]
    assert [n for _, n, _ in sorted(got[0, 100])] == [100, 101, 102, 103, 104, 105, 106]
    kept, walked, last = [], 0.0, 0.0
    for at, node, ends in sorted(got[0, 1]):
        walked, last = walked + at - last, at
        if ends or walked > 4.0:
            kept.append((node, at))
            walked = 0.0
    sampled = sorted((r.src, r.dst, round(r.dist, 9)) for r in graph.resample_chains(table, 4.0).collect() if r.dst < 100)
    pairs = zip([(0, 0.0), *kept], kept, strict=False)
    assert sampled == sorted((a, b, round(y - x, 9)) for (a, x), (b, y) in pairs)
    contracted = {(min(r.src, r.dst), max(r.src, r.dst)): r.dist for r in graph.contract_chains(table).collect()}
    assert contracted[0, 40] == pytest.approx(far[-1]) and contracted[0, 200] == 2.0 and contracted[400, 401] == 3.0


def test_connected_graphs_and_floor_graph(spark):
    nodes = lambda rows: spark.createDataFrame([(i, float(x), 0.0, 0.0) for i, x in rows], ["id", "x", "y", "z"])
    edges = lambda rows: spark.createDataFrame([(a, b, 1.0) for a, b in rows], ["src", "dst", "dist"])
    every, linked = navigation.connect(nodes([(1, 0), (2, 1)]), edges([(1, 2)]), nodes([(11, 2), (12, 4), (13, 6)]), edges([(11, 12), (12, 13)]))
    # node 11 is nearer, but an end of its graph
    assert every.count() == 5 and {(r.src, r.dst, r.dist) for r in linked.collect()} == {(1, 2, 1.0), (11, 12, 1.0), (12, 13, 1.0), (2, 12, 3.0)}
    region = spark.createDataFrame([("a", "f", r, c) for r in range(5) for c in range(30)], "scene string, floor_id string, row long, col long")
    found, sparse = navigation.floor_graph(region, region.limit(1), region.limit(0), 0, 4.0, 5.0)
    ids = {r.id for r in found.collect()}
    assert sparse.count() > 3 and {x for r in sparse.collect() for x in (r.src, r.dst)} == ids


def test_stairs_between_floors(spark):
    up = [0.1 * (i % 3) for i in range(60)] + [0.25 * i for i in range(1, 12)] + [3.0 + 0.1 * (i % 3) for i in range(60)]
    rows = [("up", i, float(i), h + 1.5, 0.0) for i, h in enumerate(up)] + [("down", i, float(i), h + 1.5, 0.0) for i, h in enumerate(reversed(up))]
    poses = spark.createDataFrame(rows, "scene string, frame_id long, x double, y double, z double")
    floors = spark.createDataFrame([(s, k, f"f{k}", 10.0 * k) for s in ("up", "down") for k in range(2)], "scene string, floor_no int, floor_id string, zero_level double")
    nodes, edges = navigation.stairs_graph(poses, floors, bins=20)
    got = {}
    for r in nodes.collect():
        got.setdefault(r.scene, []).append((r.frame_id, r.y, r.floor_id))
    n = len(up)
    climb = {i for i, h in enumerate(up) if 0.3 < h < 2.9}
    for scene in ("up", "down"):
        frames = {i for i, _, _ in got[scene]}
        assert {n - 1 - i for i in climb} <= frames if scene == "down" else climb <= frames
        assert len(frames) < 45 and min(y for _, y, _ in got[scene]) == 0.0 and {f for _, _, f in got[scene]} == {"f0"}
    assert edges.groupBy("scene").count().collect() and edges.count() == sum(len(v) - 1 for v in got.values())


def test_scenes_do_not_mix(spark):
    cameras = spark.createDataFrame([("a", 1, 0.0, 1.0, 0.0), ("b", 2, 0.0, 1.0, 0.0)], ["scene", "frame_id", "x", "y", "z"])
    rooms = spark.createDataFrame([("a", "ra", 5.0, 0.0), ("b", "rb", 9.0, 0.0), ("b", "rc", 0.1, 0.0)], ["scene", "room_id", "x", "z"])
    got = {(r.scene, r.room_id, r.frame_id) for r in scene.assign_cameras(cameras, rooms, 0.0, 5.0, ("scene",)).collect()}
    assert got == {("a", "ra", 1), ("b", "rc", 2), ("b", "rb", 2)}
    floors = spark.createDataFrame([("a", "f1", 5.0), ("a", "f0", 1.0), ("b", "g0", 3.0)], ["scene", "floor_id", "level"])
    assert {(r.scene, r.floor_id): r.floor_no for r in search.floor_ranks(floors, keys=("scene",)).collect()} == {("a", "f0"): 1, ("a", "f1"): 2, ("b", "g0"): 1}
    boxes = spark.createDataFrame([("a", 1, 0.0, 1.0), ("b", 2, 0.0, 1.0)], ["scene", "segment", "y0", "y1"])
    slabs = spark.createDataFrame([("a", "f0", 0.0, 2.0), ("b", "g0", 5.0, 9.0)], ["scene", "floor_id", "low", "high"])
    assert [(r.scene, r.floor_id) for r in scene.objects_on_floors(boxes, slabs, keys=("scene",)).collect()] == [("a", "f0")]


def test_evaluation_of_known_scores(spark):
    scores = spark.createDataFrame([("s", 0, 0, 0.9), ("s", 1, 1, 0.45), ("s", 2, 1, 0.4), ("t", 5, 5, 0.0)], "scene string, pred_id long, gt_id long, overlap double")
    totals = spark.createDataFrame([("s", 3, 2), ("t", 1, 1), ("u", 2, 0)], "scene string, pred long, gt long")
    got = {r.scene: r for r in evaluation.average_precision(scores, totals).collect()}
    tp = [sum(v > i / 10 for v in (0.9, 0.45)) for i in range(11)]
    curve = sorted((t / 2, t / 3) for t in tp)
    area = sum((r2 - r1) * (p1 + p2) / 2 for (r1, p1), (r2, p2) in itertools.pairwise(curve))
    assert (got["s"].tp, got["s"].fp, got["s"].fn) == (1, 2, 1) and got["s"].ap == pytest.approx(area) and got["s"].prec == pytest.approx(1 / 3)
    assert (got["t"].ap, got["t"].acc, got["u"].recall, got["u"].fp) == (0.0, 0.0, 0.0, 2)


def test_second_component_and_sizes(spark):
    cells = [("a", 0, c) for c in range(5)] + [("a", 5, c) for c in range(3)] + [("a", 9, 9)] + [("b", 0, 0)]
    got = raster.ranked_component(spark.createDataFrame(cells, "scene string, row long, col long"), 2, ("scene",)).collect()
    assert {tuple(r) for r in got} == {("a", 5, c) for c in range(3)}
    pixels = lambda n: spark.createDataFrame([(i % 2,) for i in range(n)], "image long")
    metrics.check_sizes(pixels(6), pixels(6), ("image",))
    with pytest.raises(ValueError):
        metrics.check_sizes(pixels(6), pixels(5), ("image",))


def test_peaks_keep_their_distance(spark):
    rng = np.random.default_rng(14)
    n = {k: rng.integers(0, 50, 80).tolist() for k in ("a", "b")}
    rows = [(k, i, v) for k, values in n.items() for i, v in enumerate(values)]
    got = {}
    for r in ordered.local_peaks(spark.createDataFrame(rows, "scene string, bin long, n long"), "n", 20, 6, ("scene",)).collect():
        got.setdefault(r.scene, set()).add(r.bin)
    for k, v in n.items():
        peaks = [i for i in range(1, 79) if v[i] > v[i - 1] and v[i] > v[i + 1] and v[i] >= 20]
        kept = []
        for i in sorted(peaks, key=lambda i: (-v[i], i)):
            if all(abs(i - j) >= 6 for j in kept):
                kept.append(i)
        assert got[k] == set(kept)


def test_stairs_of_objects_have_no_dead_ends(spark):
    ring = [("s", float(r), 0.1 * r, float(c)) for r in range(40) for c in range(40) if 8 <= max(abs(r - 20), abs(c - 20)) <= 16]
    bar = [("t", float(r), 0.0, float(c)) for r in range(5) for c in range(30)]
    points = spark.createDataFrame(ring + bar, "scene string, x double, y double, z double")
    nodes, edges = navigation.stairs_object_graph(points, 1.0, 1, 1, 4.0)
    scenes = {r.scene for r in nodes.collect()}
    assert "s" in scenes and edges.count() > 30 and nodes.where("height is null").count() == 0
    assert graph.degrees(edges).where("degree < 2").count() == 0


def _two_scenes(df):
    """The rows as scene A and, turned upside down, as scene B, with equal ids."""
    return df.withColumn("scene", F.lit("A")).unionByName(df.withColumn("scene", F.lit("B")).withColumn("x", -F.col("x")))


def test_scenes_of_equal_ids_dont_mix(spark):
    rng = np.random.default_rng(21)
    xyz = np.concatenate([rng.normal(0, 0.3, (30, 3)), rng.normal(4, 0.3, (20, 3)), rng.uniform(-9, 9, (10, 3))])
    p = cut(_points(spark, xyz, segment=[i % 4 for i in range(60)], frame=[i % 2 for i in range(60)]))
    other = _points(spark, rng.uniform(-5, 5, (40, 3))).withColumnRenamed("point_id", "map_id")
    both, both_other = cut(_two_scenes(p)), cut(_two_scenes(other))
    alone = lambda f, *tables: sorted(("A", *r) for r in map(tuple, f(*tables, ()).collect()))
    within = lambda f, *tables: sorted(map(tuple, f(*tables, ("scene",)).where("scene = 'A'").collect()))
    for f in (
        lambda a, keys: clustering.dbscan(a, "point_id", 0.6, 4, keys).select(*keys, "point_id", F.coalesce("cluster", F.lit(-1))),
        lambda a, keys: clustering.merge_masks(a, "segment", "point_id", 0.1, 0.2, 0.5, 1e-6, 1.0, keys),
        lambda a, keys: clustering.hierarchical_merge(a, "frame", "segment", "point_id", 0.4, 0.1, 0.1, 0.5, 1e-6, 0.75, keys),
    ):
        assert within(f, both) == alone(f, p)
    near = lambda a, b, keys: spatial.nearest(a, b, "point_id", "map_id", 1.0, keys)
    assert within(near, both, both_other) == alone(near, p, other)
    two = spark.createDataFrame([("A", 0, 1), ("B", 0, 1)], "scene string, a long, b long")
    got = spatial.overlap_ratio(both, two, "segment", "point_id", 0.5, keys=("scene",)).collect()
    (want,) = spatial.overlap_ratio(p, two.where("scene = 'A'").drop("scene"), "segment", "point_id", 0.5).collect()
    assert sorted((r.scene, r.overlap) for r in got) == [("A", want.overlap), ("B", want.overlap)]


def test_points_without_finite_coordinates_are_near_nothing(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 100.0, 0.0, 0.0), (3, None, 0.0, 0.0), (4, float("inf"), 0.0, 0.0)], "id long, x double, y double, z double")
    right = spark.createDataFrame([(7, 50.0, 0.0, 0.0), (8, float("nan"), 0.0, 0.0)], "map_id long, x double, y double, z double")
    got = sorted((r.id, r.map_id, r.distance) for r in spatial.nearest(left, right, "id", "map_id", 1.0).collect())
    assert got == [(1, 7, 50.0), (2, 7, 50.0)]
    assert spatial.nearest(left, right.where("map_id = 8"), "id", "map_id", 1.0).count() == 0
    assert spatial.k_nearest(left.limit(0), right, "id", "map_id", 3, 1.0).columns == ["id", "right", "d2", "rank"]


@pytest.mark.parametrize("k", [1, 4])
def test_k_nearest_at_any_density(spark, k):
    rng = np.random.default_rng(22)
    goals = np.concatenate([rng.normal(0, 0.01, (120, 3)), rng.uniform(-50, 50, (60, 3)), np.tile([[3.0, 3.0, 3.0]], (40, 1)), [[4000.0, 0, 0]]])
    probes = np.concatenate([rng.normal(0, 0.01, (30, 3)), rng.uniform(-60, 60, (40, 3)), [[3.0, 3.0, 3.0], [-9000.0, 5, 5], [2000.0, 1, 1]]])
    got = {}
    for r in spatial.k_nearest(_points(spark, probes), _points(spark, goals).withColumnRenamed("point_id", "map_id"), "point_id", "map_id", k, 1.0).collect():
        got.setdefault(r.point_id, {})[r["rank"]] = r.right.map_id
    d2 = ((probes[:, None] - goals[None]) ** 2)
    d2 = d2[..., 0] + d2[..., 1] + d2[..., 2]
    want = {i: dict(enumerate(np.lexsort((np.arange(len(goals)), d2[i]))[:k].tolist(), 1)) for i in range(len(probes))}
    assert got == want


def test_contacts_equal_all_distances(spark):
    rng = np.random.default_rng(23)
    xyz = np.concatenate([rng.uniform(0, 3, (70, 3)), rng.integers(0, 3, (50, 3)), [[1.0, 1.0, 1.0]] * 3])
    seg = [i % 5 for i in range(len(xyz))]
    for radius in (0.3, 1.0, 2.5):
        got = {(r.a, r.point, r.b) for r in spatial.contacts(_points(spark, xyz, segment=seg), "segment", "point_id", radius).collect()}
        d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
        assert got == {(seg[i], i, seg[j]) for i in range(len(xyz)) for j in range(len(xyz)) if seg[i] != seg[j] and d2[i, j] < radius * radius}


def test_box_around_very_many_small_ones(spark):
    n = 3000
    row = lambda i, low, side: (i, low, low + side, 0.0, side, 0.0, side)
    boxes = spark.createDataFrame([row(i, 2.0 * i, 1.0) for i in range(n)] + [row(n, 0.5, 2.0 * n), row(n + 1, 0.25, 1.0)], ["id", "x0", "x1", "y0", "y1", "z0", "z1"])
    got = {(r.a, r.b) for r in spatial.iou_pairs(boxes, "id", 1.0, 0.0).collect()}
    assert got == {(i, n) for i in range(n)} | {(0, n + 1), (n, n + 1)}


def test_floors_named_by_any_number_word(spark):
    asked = {"lamp on floor six": 6, "lamp on the sixth floor": 6, "lamp on the twelfth floor": 12, "bed on floor twenty one": 21, "bed on the twenty-first floor": 21, "bed on the 22nd floor": 22, "bed on the ninetieth floor": 90,
             "sofa on the ground floor": 0, "sofa on floor 3": 3, "sofa on the upper floor": -1, "sofa on the kitchen": None, "sofa": None, "sofa on the second floor": 2}
    rows = spark.createDataFrame([(q,) for q in asked], "query string").select("query", phrases.parse_floor(F.col("query")).alias("n"), phrases.parse_object(F.col("query")).alias("o")).collect()
    assert {r["query"]: r.n for r in rows} == asked
    assert {r.o for r in rows if r.n is not None} == {"lamp", "bed", "sofa"}
