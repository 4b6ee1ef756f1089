"""Sources, sinks and streams round trip."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from atrium import streaming
from atrium.sources import frames, ply, scenes


def test_ply_round_trip_and_ascii(spark, tmp_path):
    ply.register(spark)
    points = spark.createDataFrame([("a", 1.5, 2.0, 3.0, 0.0, 1.0, 0.2), ("a", -1.0, 0.0, 9.0, 1.0, 0.0, 0.4), ("b", 7.0, 8.0, 9.0, 0.6, 0.6, 0.6)], "cloud_id string, x double, y double, z double, r double, g double, b double")
    assert sum(r.n_points for r in ply.write_ply(points, str(tmp_path)).collect()) == 3
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty int label\nend_header\n0 1 2 5\n3 4 5 6\n")
    got = spark.read.format("ply").load(str(tmp_path))
    rows = {(r.cloud_id, r.x, r.y, r.z) for r in got.collect()}
    assert rows == {("a", 1.5, 2.0, 3.0), ("a", -1.0, 0.0, 9.0), ("b", 7.0, 8.0, 9.0), ("c", 0.0, 1.0, 2.0), ("c", 3.0, 4.0, 5.0)}
    assert {r.label for r in got.where("cloud_id = 'c'").collect()} == {5, 6}


def test_frames_join_by_number(spark, tmp_path):
    for sub in ("color", "depth", "pose"):
        (tmp_path / sub).mkdir()
    for i in (2, 10, 11):
        (tmp_path / "color" / f"{i}.jpg").write_bytes(bytes([i]))
        (tmp_path / "depth" / f"{i}.png").write_bytes(bytes([i, i]))
        if i != 11:
            (tmp_path / "pose" / f"{i}.txt").write_text("\n".join(" ".join(map(str, r)) for r in np.eye(4) * 1.0 + np.array([[0, 0, 0, i]] + [[0] * 4] * 3)))
    got = {r.frame_id: r for r in frames.read_frames(spark, str(tmp_path), "scans").collect()}
    assert set(got) == {2, 10} and got[10].rgb == bytes([10]) and got[10].depth == bytes([10, 10]) and got[10].pose[3] == 10.0


def test_pixels_to_points(spark):
    eye = [1.0, 0, 0, 5, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    cameras = spark.createDataFrame([(1, [float(x) for x in eye], 2.0, 2.0, 1.0, 1.0, 1000.0)], "frame_id int, pose array<double>, fx double, fy double, cx double, cy double, depth_scale double")
    pixels = spark.createDataFrame([(1, 1, 3, 2000), (1, 0, 0, 0)], "frame_id int, row int, col int, depth_raw int")
    assert [(r.x, r.y, r.z) for r in frames.pixels_to_points(pixels, cameras).collect()] == [(7.0, 0.0, 2.0)]


def test_scene_documents(spark, tmp_path):
    doc = {"levels": [{"id": 0, "lower": 0.0, "upper": 3.0, "regions": [0, 1], "objects": []}], "regions": [{"id": 1, "floor_id": 0, "category": "hall"}], "objects": [{"id": 7, "category": "lamp", "region_id": 1, "floor_id": 0}]}
    (tmp_path / "scene.json").write_text(json.dumps(doc, indent=1))
    levels, regions, objects = scenes.read_scene(spark, str(tmp_path / "scene.json"))
    assert (levels.head().floor_id, regions.head().room_id, objects.head().object_id) == ("0", "0_1", "0_1_7")
    scenes.write_scene(levels.drop("floor_id"), regions.drop("room_id"), objects.drop("object_id"), str(tmp_path / "out"))
    again = scenes.read_scene(spark, str(tmp_path / "out"))
    assert again[2].head().object_id == "0_1_7"


def test_graph_tables_and_dimensions(spark, tmp_path):
    floors = spark.createDataFrame([("0", "f", ["0_1"], [[0.0]], 3.0, 0.0)], scenes.FLOORS)
    rooms = spark.createDataFrame([("0_10", "0", "hall", [], None, 3.0, 0.0, None, None)], scenes.ROOMS)
    objects = spark.createDataFrame([("0_10_2", "0_10", "lamp", None, [1.0, 2.0])], scenes.OBJECTS)
    scenes.write_graph(floors, rooms, objects, str(tmp_path / "g"))
    f, r, o = scenes.read_graph(spark, str(tmp_path / "g"))
    assert f.count() == 1 and r.where("floor = 0").head().room_id == "0_10" and o.head().embedding == [1.0, 2.0]
    (tmp_path / "sep.csv").write_text('scene,heights\ns1,"[0.1, 2.5]"\n')
    assert scenes.read_floor_separation(spark, str(tmp_path / "sep.csv")).head().heights == [0.1, 2.5]
    (tmp_path / "sem.txt").write_text('HM3D Semantic Annotations\n1,FF00AA,"shelf, wall",4\n2,00FF00,lamp,0\n')
    assert [(x.id, x.category, x.region) for x in scenes.read_semantic_text(spark, str(tmp_path / "sem.txt")).orderBy("id").collect()] == [(1, "shelf, wall", 4), (2, "lamp", 0)]
    faces = spark.createDataFrame([(0, 5, [0, 1, 2]), (1, 6, [2, 1, 0])], "face_id int, object_id int, vertex_indices array<int>")
    vertices = spark.createDataFrame([(i, float(i)) for i in range(3)], "vertex_id int, x double")
    got = scenes.mesh_vertices(faces, vertices, spark.createDataFrame([(5, 9)], "object_id int, class_id int"))
    assert got.groupBy("class_id").count().orderBy("class_id").collect() == [(0, 3), (9, 3)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"), F.lit(1.0).alias("z"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.merge_into(stream, str(tmp_path / "map"), 2.0, str(tmp_path / "check")).awaitTermination(120)
    got = {(r.vx, r.vy): (round(r.x, 9), r.n) for r in streaming.compacted(spark, str(tmp_path / "map")).collect()}
    want = {(r.vx, r.vy): (round(r.sum_x / r.n, 9), r.n) for r in streaming.voxel_stream(rows, 2.0).collect()}
    assert got == want


def test_pose_windows_close_by_watermark(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:10", 1.0), (1, "2024-01-01 00:04:00", 3.0), (1, "2024-01-01 02:00:00", 5.0)], "user_id int, t string, y double").select("user_id", F.to_timestamp("t").alias("ts"), "y")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.pose_windows(stream).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.low, r.high, r.n) for r in spark.table("w").collect()] == [(1.0, 3.0, 2)]


def _png16(image, kinds):
    """A 16-bit greyscale PNG file whose lines take the given filters in turn."""
    import struct
    import zlib

    h, w = image.shape
    raw = np.zeros((h + 1, 2 * w + 2), np.int64)
    raw[1:, 2::2], raw[1:, 3::2] = image >> 8, image & 255
    lines = b""
    for y in range(h):
        kind, line, above = kinds[y % len(kinds)], raw[y + 1], raw[y]
        a, b, c = line[:-2], above[2:], above[:-2]
        p = a + b - c
        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        guess = [0 * b, a, b, (a + b) // 2, paeth][kind]
        lines += bytes([kind]) + ((line[2:] - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_depth_files(spark):
    image = np.random.default_rng(1).integers(0, 65536, (7, 5))
    image[2:4] = image[1]
    rows = spark.createDataFrame([(4, bytearray(_png16(image, [0, 1, 2, 3, 4]))), (9, bytearray(_png16(image + 0, [4, 3])))], "frame_id int, depth binary")
    for frame in (4, 9):
        got = {(r.row, r.col): r.depth_raw for r in frames.decode_depth(rows).where(f"frame_id = {frame}").collect()}
        assert got == {(r, c): int(image[r, c]) for r in range(7) for c in range(5)}


def test_camera_files_and_pose_lists(spark, tmp_path):
    (tmp_path / "k.txt").write_text("577.5 0 318.9 0\n0 578.7 242.6 0\n0 0 1 0\n0 0 0 1\n")
    (tmp_path / "k3.txt").write_text("577.5 0 318.9\n0 578.7 242.6\n0 0 1\n")
    for name in ("k.txt", "k3.txt"):
        assert tuple(frames.read_matrix_intrinsics(spark, str(tmp_path / name)).head()) == (577.5, 578.7, 318.9, 242.6)
    (tmp_path / "cam_params.json").write_text(json.dumps({"camera": {"w": 1200, "h": 680, "fx": 600.0, "fy": 600.0, "cx": 599.5, "cy": 339.5, "scale": 6553.5}}, indent=1))
    assert frames.read_camera_file(spark, str(tmp_path / "cam_params.json")).head().depth_scale == 6553.5
    (tmp_path / "results").mkdir()
    (tmp_path / "results" / "frame000000.jpg").write_bytes(b"a")
    (tmp_path / "results" / "depth000000.png").write_bytes(b"b")
    eye = "1 0 0 2 0 1 0 3 0 0 1 4 0 0 0 1"
    (tmp_path / "traj.txt").write_text(eye + "\n")
    one = frames.read_frames(spark, str(tmp_path), "results").head()
    assert (one.frame_id, one.depth_scale, one.pose[3]) == (0, 6553.5, 2.0)
    (tmp_path / "list.tsv").write_text(eye.replace(" ", "\t") + "\n")
    pose = frames.read_pose_list(spark, str(tmp_path / "list.tsv")).head()
    assert (pose.x, pose.y, pose.z, pose.quaternion) == (2.0, 3.0, 4.0, [1.0, 0.0, 0.0, 0.0])


def test_dimension_files_and_stores(spark, tmp_path):
    (tmp_path / "classes.json").write_text(json.dumps({"classes": [{"id": 3, "name": "sofa"}, {"id": 7, "name": "lamp"}]}, indent=1))
    assert [tuple(r) for r in scenes.read_classes(spark, str(tmp_path / "classes.json")).orderBy("class_id").collect()] == [(3, "sofa"), (7, "lamp")]
    (tmp_path / "labels.csv").write_text('Scene Name,Region #,"Weighted Votes, all",Label\ns1,0,9,kitchen\ns1,1,2,"hall, wide"\ns2,0,1,bath\n')
    labels = scenes.read_region_labels(spark, str(tmp_path / "labels.csv"), ("Scene Name", "Region #", "Label"), "s1")
    regions = spark.createDataFrame([("s1", 1), ("s1", 5)], "scene string, region_id int")
    assert {(r.region_id, r.category, r.labelled) for r in scenes.label_regions(regions, labels).collect()} == {(1, "hall, wide", True), (5, None, False)}
    names = spark.createDataFrame([("small", 0, "sofa"), ("small", 1, "lamp"), ("other", 0, "wall")], "vocabulary string, class int, name string")
    scenes.write_vocabulary(names, spark.createDataFrame([("sofa", [1.0, 0.0]), ("lamp", [0.0, 1.0])], "name string, prompt array<double>"), str(tmp_path / "v"))
    assert {(r["class"], r.name, tuple(r.prompt)) for r in scenes.read_vocabulary(spark, str(tmp_path / "v"), "small").collect()} == {(0, "sofa", (1.0, 0.0)), (1, "lamp", (0.0, 1.0))}
    with pytest.raises(ValueError):
        scenes.read_vocabulary(spark, str(tmp_path / "v"), "none")
    points = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "point_id long, x double, y double, z double")
    scenes.write_cloud(points, spark.createDataFrame([(0, [3.0, 4.0])], "point_id long, embedding array<float>"), str(tmp_path / "c"))
    assert scenes.read_cloud(spark, str(tmp_path / "c"), True)[1].head().embedding == pytest.approx([0.6, 0.8])
    scenes.write_navigation(points.withColumnRenamed("point_id", "id"), spark.createDataFrame([(0, 1, 2.5)], "src long, dst long, dist double"), str(tmp_path / "n"))
    assert scenes.read_navigation(spark, str(tmp_path / "n"))[1].head().dist == 2.5
    ply.register(spark)
    cloud = spark.createDataFrame([("pcd_2", 1.0, 2.0, 3.0, 0.0, 0.0, 0.0), ("full", 1.0, 2.0, 3.0, 0.0, 0.0, 0.0)], "cloud_id string, x double, y double, z double, r double, g double, b double")
    ply.write_ply(cloud, str(tmp_path / "m")).collect()
    masks, features = scenes.read_masks(spark, str(tmp_path / "m"), spark.createDataFrame([(1, [0.0]), (2, [1.0])], "mask_id int, embedding array<double>"))
    assert [r.mask_id for r in masks.collect()] == [2] and [r.mask_id for r in features.collect()] == [2]
    level = spark.createDataFrame([("s1", 0, 0.0), ("s2", 0, 1.0)], "scene string, id int, lower double")
    scenes.write_scene(level, level.select("scene", "id"), level.select("scene", "id"), str(tmp_path / "docs"), "scene")
    assert {r.lower for r in scenes.read_scene(spark, str(tmp_path / "docs/scene=s2"))[0].collect()} == {1.0}
