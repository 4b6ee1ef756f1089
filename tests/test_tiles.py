"""Neighbours by tiles against all distances, and rows that lie at one place."""

import random

import pytest
from pyspark.sql import functions as F

from atrium.operators import spatial, tiles

AXES = ("x", "y", "z")


def _brute(rows, sided):
    want = {}
    for s, p, a, *at in rows:
        for t, _, b, *there in rows:
            if s == t and (a % 2 != b % 2 if sided else a != b) and sum((u - v) ** 2 for u, v in zip(at, there, strict=True)) < 0.49:
                want.setdefault((s, a % 2 if sided else 0, a, b), set()).add(p)
    return {k: len(v) for k, v in want.items()}


@pytest.mark.parametrize("sided", [False, True])
def test_near_numbers_equal_all_distances(spark, monkeypatch, sided):
    """In scenes of one tile and of many; some points have several rows, at one place or at two."""
    r = random.Random(1)
    rows = [(s, i % 397, r.randrange(5), r.choice([0.0, 0.5, 1.0, r.random() * 9]), r.random() * 9, float(r.randrange(4))) for s in (0, 1) for i in range(450)]
    df = spark.createDataFrame(rows, "scene long, point long, a long, x double, y double, z double").withColumn("side", F.col("a") % 2 if sided else F.lit(0))
    want = _brute(rows, sided)
    monkeypatch.setattr(tiles, "TILE", 60)
    for whole in (100_000, 10):
        monkeypatch.setattr(tiles, "WHOLE", whole)
        for kind in ("long", "string"):
            got = tiles.near_numbers(df.withColumn("point", F.col("point").cast(kind)), 0.7, ("scene",), AXES, sided).collect()
            assert {(x.scene, x.side, x.a, x.b): x.n for x in got} == want, (whole, kind)


def test_counts_of_many_points_at_one_place(spark):
    """60,000 points of each side at two places: no row is made for a pair of points, of which there are 1.8 billion."""
    at = lambda name: spark.range(60000).select(F.col("id").alias("point"), F.lit(1).alias(name), *[(F.col("id") % 2 * 5).cast("double").alias(x) for x in AXES])
    (row,) = spatial.near_counts(at("p"), at("g"), "p", "g", "point", 0.5).collect()
    assert (row.na, row.nb) == (60000, 60000)


def test_pixel_features_of_masks_of_all_frames(spark):
    """Features without a frame give each pixel the normalised sum of its masks', as features by frame do."""
    from atrium.operators import masks

    pixels = [(f, m, row, 0) for f in range(3) for m in range(3) for row in range(4) if (f + m + row) % 3]
    vectors = {0: [1.0, 0.0], 1: [1.0, 2.0], 2: [-3.0, 0.5]}
    px = spark.createDataFrame(pixels, "frame_id long, mask_id long, row long, col long")
    features = spark.createDataFrame(list(vectors.items()), "mask_id long, embedding array<double>")
    one = {(p.frame_id, p.row): p.embedding for p in masks.pixel_features(px, features, of=()).collect()}
    two = {(p.frame_id, p.row): p.embedding for p in masks.pixel_features(px, px.select("frame_id", "mask_id").distinct().join(features, "mask_id")).collect()}
    assert one.keys() == two.keys() == {(f, row) for f, _, row, _ in pixels}
    for f, row in one:
        total = [sum(vectors[m][i] for g, m, at, _ in pixels if (g, at) == (f, row)) for i in (0, 1)]
        norm = sum(v * v for v in total) ** 0.5
        assert one[f, row] == pytest.approx([v / norm for v in total]) and two[f, row] == pytest.approx(one[f, row])


@pytest.mark.parametrize("how", ["hierarchical", "sequential"])
def test_scenes_merged_in_a_task_equal_those_merged_by_joins(spark, monkeypatch, how):
    from atrium.operators import clustering

    r = random.Random(3)
    rows = [(s, f, f * 10 + int(x // 2), i, x, r.random(), r.random()) for s in range(2) for f in range(5) for i, x in enumerate(r.random() * 4 + f / 9 for _ in range(40))]
    df = spark.createDataFrame(rows, "scene long, frame long, segment long, point long, x double, y double, z double")
    more = (0.5, 0.1, 0.1, 0.4, 0.25, 0.6) if how == "hierarchical" else (0.1, 0.4, 0.4, 0.25)

    def merged():
        out = getattr(clustering, f"{how}_merge")(df, "frame", "segment", "point", *more, keys=("scene",))
        return sorted((x.scene, x.segment, x.point, round(x.x, 9), round(x.y, 9), round(x.z, 9)) for x in out.collect())

    one = merged()
    monkeypatch.setattr(tiles, "WHOLE", 10)
    assert one == merged()
    assert 1 < len({x[:2] for x in one}) < len({(x[0], x[2]) for x in rows})


def test_clusters_of_places_equal_those_by_joins(spark, monkeypatch):
    """And 40,000 points at one place, whose 1.6 billion pairs are not made."""
    from atrium.operators import clustering

    r = random.Random(5)
    rows = [(s, i, round(r.random() * 9), round(r.random() * 9) / 1.0, r.random()) for s in range(2) for i in range(160)] + [(0, 999, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame([(s, i, float(x), y, z) for s, i, x, y, z in rows], "scene long, point long, x double, y double, z double")
    run = lambda: sorted((x.scene, x.point, -1 if x.cluster is None else x.cluster) for x in clustering.dbscan(df, "point", 1.01, 6, ("scene",)).collect())
    one = run()
    many = spark.range(40000).select(F.col("id").alias("point"), *[F.lit(1.0).alias(a) for a in AXES])
    assert clustering.dbscan(many, "point", 0.5, 40000).where("cluster = 0").count() == 40000
    monkeypatch.setattr(tiles, "WHOLE", 10)
    assert one == run()
    assert len({x[2] for x in one}) > 2 and (0, 999, -1) in one


def test_rooms_of_many_points_and_cells_at_one_place(spark):
    """50,000 points of an object meet 50,000 cells of its room as one place each; a cell counts once however many rows it has."""
    from atrium.plans import scene

    points = spark.range(50000).select(F.col("id").alias("point_id"), F.lit(7).alias("segment"), F.lit(1.0).alias("x"), F.lit(1.0).alias("z"))
    cells = spark.range(50000).select(F.lit("r").alias("room_id"), (F.col("id") % 25000).alias("cell_id"), F.lit(1.0).alias("x"), F.lit(1.1).alias("z"))
    more = spark.range(30000).select(F.lit("s").alias("room_id"), (F.col("id") + 50000).alias("cell_id"), F.lit(1.1).alias("x"), F.lit(1.0).alias("z"))
    (row,) = scene.assign_rooms(points, cells.unionByName(more)).collect()
    assert (row.segment, row.room_id) == (7, "s")


def test_vectors_clustered_by_blocks_equal_those_by_joins(spark, monkeypatch):
    from atrium.operators import clustering

    r = random.Random(7)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i % 2, i, [c + r.gauss(0, 0.45) for c in centres[i % 6]]) for i in range(160)] + [(0, 900, [0.0] * 8)]
    df = spark.createDataFrame(rows, "room long, item long, embedding array<double>")
    run = lambda: sorted((x.room, x.item, -1 if x.cluster is None else x.cluster) for x in clustering.cosine_dbscan(df, "item", 0.15, 4, ("room",)).collect())
    monkeypatch.setattr(clustering, "_BLOCK", 16)
    one = run()
    monkeypatch.setattr(tiles, "WHOLE", 10)
    assert one == run()
    assert len({x[2] for x in one}) > 3 and (0, 900, -1) in one
