"""Points, boxes, cameras and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.phrases import is_structural
from ..operators import raster, spatial
from ..plans import scene
from .tables import POINTS, POSES, Registry, points, poses, table

REGISTRY = Registry()
_BOXES = f"{POINTS}, boxes AS (SELECT segment, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, count(*) AS n_points FROM points GROUP BY segment)"


@REGISTRY.add("a2_voxel_downsample", f"WITH {POINTS} SELECT CAST(floor(x / 5) AS BIGINT) AS vx, CAST(floor(y / 2) AS BIGINT) AS vy, CAST(floor(z / 10) AS BIGINT) AS vz, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, count(*) AS n_points FROM points GROUP BY 1, 2, 3")
def a2(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("vx", G.voxel(F.col("x"), 5)).withColumn("vy", G.voxel(F.col("y"), 2)).withColumn("vz", G.voxel(F.col("z"), 10))
    return p.groupBy("vx", "vy", "vz").agg(F.round(F.avg("x"), 9).alias("x"), F.round(F.avg("y"), 9).alias("y"), F.round(F.avg("z"), 9).alias("z"), F.count("*").alias("n_points"))


@REGISTRY.add("a8_histogram_2d", f"WITH {POINTS} SELECT CAST(floor(x / 4) AS BIGINT) AS row, CAST(floor(z / 8) AS BIGINT) AS col, count(*) AS n FROM points GROUP BY 1, 2")
def a8(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.groupBy(F.floor(F.col("x") / 4).cast("long").alias("row"), F.floor(F.col("z") / 8).cast("long").alias("col")).agg(F.count("*").alias("n"))


@REGISTRY.add("a9_occupancy", f"WITH {POINTS} SELECT CAST(floor(x / 4) AS BIGINT) AS row, CAST(floor(z / 4) AS BIGINT) AS col, count(*) AS n, max(y) AS height FROM points GROUP BY 1, 2")
def a9(spark, sf_dir):
    return raster.occupied(points(spark, sf_dir), 4.0)


@REGISTRY.add("a10_top_down_colours", f"""WITH {POINTS}, c AS (SELECT *, row_number() OVER (PARTITION BY floor(x / 4), floor(z / 4) ORDER BY y DESC, point_id) AS rank FROM points)
SELECT CAST(floor(x / 4) AS BIGINT) AS row, CAST(floor(z / 4) AS BIGINT) AS col, segment, frame_id FROM c WHERE rank = 1""")
def a10(spark, sf_dir):
    return raster.top_colours(points(spark, sf_dir), 4.0, (), "point_id", ("segment", "frame_id"))


@REGISTRY.add("p1_back_projection", f"WITH {POINTS} SELECT point_id, round((x - 25) * z / 26, 6) AS cx, round((y - 5) * z / 26, 6) AS cy, z AS cz FROM points WHERE z > 0")
def p1(spark, sf_dir):
    X, Y, Z = G.back_project(F.col("x"), F.col("y"), F.col("z"), F.lit(26.0), F.lit(26.0), F.lit(25.0), F.lit(5.0))
    return points(spark, sf_dir).where("z > 0").select("point_id", F.round(X, 6).alias("cx"), F.round(Y, 6).alias("cy"), Z.alias("cz"))


@REGISTRY.add("p2_rigid_transform", f"WITH {POINTS} SELECT point_id, round(0.0 * x + -1.0 * y + 0.0 * z + 1.5, 6) AS tx, round(1.0 * x + 0.0 * y + 0.0 * z + -2.0, 6) AS ty, round(0.0 * x + 0.0 * y + 1.0 * z + 0.25, 6) AS tz FROM points")
def p2(spark, sf_dir):
    pose = F.array(*map(F.lit, [0.0, -1.0, 0.0, 1.5, 1.0, 0.0, 0.0, -2.0, 0.0, 0.0, 1.0, 0.25, 0.0, 0.0, 0.0, 1.0]))
    tx, ty, tz = G.transform(pose, F.col("x"), F.col("y"), F.col("z"))
    return points(spark, sf_dir).select("point_id", F.round(tx, 6).alias("tx"), F.round(ty, 6).alias("ty"), F.round(tz, 6).alias("tz"))


@REGISTRY.add("p5_bird_eye_view", f"""WITH {POINTS}, low AS (SELECT segment, min(y) AS y FROM points GROUP BY segment)
SELECT segment, CAST(floor(x / 2) AS BIGINT) AS vx, CAST(floor(z / 2) AS BIGINT) AS vz, round(avg(x), 9) AS x, round(avg(p.z), 9) AS z, min(low.y) AS y, count(*) AS n FROM points p JOIN low USING (segment) GROUP BY 1, 2, 3""")
def p5(spark, sf_dir):
    p = points(spark, sf_dir)
    low = p.groupBy("segment").agg(F.min("y").alias("low"))
    flat = p.join(low, "segment").groupBy("segment", G.voxel(F.col("x"), 2).alias("vx"), G.voxel(F.col("z"), 2).alias("vz"))
    return flat.agg(F.round(F.avg("x"), 9).alias("x"), F.round(F.avg("z"), 9).alias("z"), F.min("low").alias("y"), F.count("*").alias("n"))


@REGISTRY.add("p6_world_to_grid", f"WITH {POINTS}, low AS (SELECT min(x) AS lx, min(z) AS lz FROM points) SELECT point_id, CAST(trunc((x - lx) / 0.3) AS INTEGER) AS row, CAST(trunc((z - lz) / 0.3) AS INTEGER) AS col FROM points, low")
def p6(spark, sf_dir):
    p = points(spark, sf_dir)
    low = p.agg(F.min("x").alias("lx"), F.min("z").alias("lz"))
    return p.join(F.broadcast(low)).select("point_id", G.world_to_grid(F.col("x"), F.col("lx"), 0.3).alias("row"), G.world_to_grid(F.col("z"), F.col("lz"), 0.3).alias("col"))


@REGISTRY.add("p9_segment_bounds", f"WITH {_BOXES} SELECT segment, x0, x1, y0, y1, z0, z1, n_points FROM boxes")
def p9(spark, sf_dir):
    return spatial.bounds(points(spark, sf_dir), ("segment",))


@REGISTRY.add("p16_colour_ids", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey % 256 + 256 * (l_suppkey % 256) + 65536 * CAST(l_linenumber AS BIGINT) AS id,
lpad(printf('%X', l_partkey % 256), 2, '0') || lpad(printf('%X', l_suppkey % 256), 2, '0') || lpad(printf('%X', CAST(l_linenumber AS BIGINT)), 2, '0') AS hex FROM lineitem""")
def p16(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    r, g, b = F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_linenumber").cast("long")
    return line.select("l_orderkey", b.alias("line"), G.rgb_to_id(r, g, b).alias("id"), G.rgb_hex(r, g, b).alias("hex"))


@REGISTRY.add("f4_height_slabs", f"""WITH {POINTS} SELECT segment, sum(CASE WHEN y BETWEEN 2 AND 6 THEN 1 ELSE 0 END)::BIGINT AS slab, sum(CASE WHEN y >= 1.5 AND y < 7.7 THEN 1 ELSE 0 END)::BIGINT AS wall,
sum(CASE WHEN y > 0.2 AND y < 1.5 THEN 1 ELSE 0 END)::BIGINT AS obstacle, sum(CASE WHEN y < 1.5 THEN 1 ELSE 0 END)::BIGINT AS region FROM points GROUP BY segment""")
def f4(spark, sf_dir):
    y = F.col("y")
    count = lambda c: F.sum(c.cast("long"))
    return points(spark, sf_dir).groupBy("segment").agg(count(y.between(2, 6)).alias("slab"), count((y >= 1.5) & (y < 7.7)).alias("wall"), count((y > 0.2) & (y < 1.5)).alias("obstacle"), count(y < 1.5).alias("region"))


@REGISTRY.add("f2_far_mask_filter", f"WITH {POINTS} SELECT segment, count(*) AS n FROM points GROUP BY segment HAVING avg(z) <= 53 AND count(*) >= 100")
def f2(spark, sf_dir):
    return points(spark, sf_dir).groupBy("segment").agg(F.avg("z").alias("depth"), F.count("*").alias("n")).where("depth <= 53 and n >= 100").select("segment", "n")


@REGISTRY.add("f12_structural_names", "SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(lower(p_name), 'wall|floor|ceiling|railing|roof|void|unlabeled|misc')")
def f12(spark, sf_dir):
    return table(spark, sf_dir, "part").where(~is_structural(F.col("p_name"))).select("p_partkey", "p_name")


@REGISTRY.add("f14_box_crop", f"WITH {POINTS} SELECT point_id, segment FROM points WHERE x BETWEEN 10 AND 30 AND y BETWEEN 2 AND 8 AND z BETWEEN 20 AND 60")
def f14(spark, sf_dir):
    return spatial.crop(points(spark, sf_dir), (10, 2, 20), (30, 8, 60)).select("point_id", "segment")


@REGISTRY.add("p8_extrusion", f"WITH {POINTS}, cells AS (SELECT DISTINCT CAST(floor(x / 10) AS BIGINT) AS row, CAST(floor(z / 10) AS BIGINT) AS col FROM points) SELECT row, col, CAST(level AS INTEGER) AS level, round(level * 0.5, 6) AS y FROM cells, range(0, 6) AS t(level)")
def p8(spark, sf_dir):
    cells = raster.occupied(points(spark, sf_dir), 10.0).select("row", "col")
    return spatial.extrude(cells, F.lit(0.0), F.lit(2.5), 0.5).select("row", "col", "level", F.round("y", 6).alias("y"))


def _map_points(spark, sf_dir):
    """The map that points are snapped to: one point a part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("map_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 11).cast("double").alias("y"), (F.col("p_retailprice") / 20).alias("z"), (F.col("p_size") % 5).cast("long").alias("label"))


_MAP = "map AS (SELECT p_partkey AS map_id, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 11 AS DOUBLE) AS y, p_retailprice / 20 AS z, CAST(p_size % 5 AS BIGINT) AS label FROM part)"


@REGISTRY.add("j1_nearest_point", f"""WITH {POINTS}, {_MAP}, d AS (SELECT a.point_id, arg_min(b.map_id, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.map_id)) AS map_id, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d2 FROM points a, map b GROUP BY a.point_id)
SELECT point_id, map_id, round(sqrt(d2), 6) AS distance FROM d""")
def j1(spark, sf_dir):
    near = spatial.nearest(points(spark, sf_dir).select("point_id", "x", "y", "z"), _map_points(spark, sf_dir).drop("label"), "point_id", "map_id", 4.0)
    return near.select("point_id", "map_id", F.round("distance", 6).alias("distance"))


_AROUND = "(SELECT *, floor(x) + i AS cx, floor(y) + j AS cy, floor(z) + k AS cz FROM points, range(-1, 2) t(i), range(-1, 2) u(j), range(-1, 2) v(k))"


@REGISTRY.add("j6_segment_overlap", f"""WITH {POINTS}, h AS (SELECT a.segment AS a, b.segment AS b, a.point_id AS pa, b.point_id AS pb FROM {_AROUND} a JOIN points b ON a.cx = floor(b.x) AND a.cy = floor(b.y) AND a.cz = floor(b.z) AND a.segment < b.segment AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 1.0),
m AS (SELECT a, b, count(DISTINCT pa) AS na, count(DISTINCT pb) AS nb FROM h GROUP BY a, b), s AS (SELECT segment, count(*) AS n FROM points GROUP BY segment)
SELECT a.segment AS a, b.segment AS b, round(greatest(coalesce(na, 0) / a.n, coalesce(nb, 0) / b.n), 6) AS overlap FROM s a JOIN s b ON a.segment < b.segment LEFT JOIN m ON m.a = a.segment AND m.b = b.segment""")
def j6(spark, sf_dir):
    p = points(spark, sf_dir)
    ids = p.select("segment").distinct()
    pairs = ids.select(F.col("segment").alias("a")).join(ids.select(F.col("segment").alias("b")), F.col("a") < F.col("b"))
    return spatial.overlap_ratio(p, pairs, "segment", "point_id", 1.0).select("a", "b", F.round("overlap", 6).alias("overlap"))


@REGISTRY.add("j8_box_iou_pairs", f"""WITH {_MAP}, i AS (SELECT a.map_id AS a, b.map_id AS b, greatest(0, least(a.x, b.x) + 3 - greatest(a.x, b.x)) * greatest(0, least(a.y, b.y) + 3 - greatest(a.y, b.y)) * greatest(0, least(a.z, b.z) + 3 - greatest(a.z, b.z)) AS inter FROM map a JOIN map b ON a.map_id < b.map_id)
SELECT a, b, round(inter / (54 - inter), 6) AS iou FROM i WHERE inter / (54 - inter) > 0.05""")
def j8(spark, sf_dir):
    p = _map_points(spark, sf_dir)
    boxes = p.select("map_id", *[c for a in ("x", "y", "z") for c in (F.col(a).alias(f"{a}0"), (F.col(a) + 3).alias(f"{a}1"))])
    return spatial.iou_pairs(boxes, "map_id", 4.0, 0.05).select("a", "b", F.round("iou", 6).alias("iou"))


@REGISTRY.add("j13_floor_interval_join", f"""WITH {POINTS}, m AS (SELECT segment, avg(y) AS mean_height FROM points GROUP BY segment), f AS (SELECT CAST(r_regionkey AS BIGINT) AS floor_id, 4.6 + 0.2 * r_regionkey AS low, 4.8 + 0.2 * r_regionkey AS high FROM region)
SELECT segment, floor_id FROM m JOIN f ON mean_height > low AND mean_height < high""")
def j13(spark, sf_dir):
    means = points(spark, sf_dir).groupBy("segment").agg(F.avg("y").alias("mean_height"))
    floors = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("floor_id"), (4.6 + 0.2 * F.col("r_regionkey")).alias("low"), (4.8 + 0.2 * F.col("r_regionkey")).alias("high"))
    return spatial.interval_join(means, F.broadcast(floors), "mean_height", "low", "high").select("segment", "floor_id")


@REGISTRY.add("j20_knn_label_vote", f"""WITH {_MAP}, a AS (SELECT c_custkey, c_acctbal / 200 AS x, CAST(c_nationkey % 11 AS DOUBLE) AS y, CAST(c_custkey % 100 AS DOUBLE) AS z FROM customer),
d AS (SELECT c_custkey, map_id, label, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM a, map b),
n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, map_id) AS rank FROM d), v AS (SELECT c_custkey, label, count(*) AS votes FROM n WHERE rank <= 5 GROUP BY c_custkey, label),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY votes DESC, label) AS rank FROM v) SELECT c_custkey, label, votes FROM r WHERE rank = 1""")
def j20(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 200).alias("x"), (F.col("c_nationkey") % 11).cast("double").alias("y"), (F.col("c_custkey") % 100).cast("double").alias("z"))
    return spatial.knn_vote(left, _map_points(spark, sf_dir), "c_custkey", "map_id", "label", 5, 8.0)


@REGISTRY.add("j22_height_interpolation", f"""WITH {POINTS}, cells AS (SELECT floor(x) AS x, floor(z) AS z, max(y) AS y FROM points GROUP BY 1, 2), e AS (SELECT DISTINCT x + i AS x, z + j AS z FROM cells, range(-1, 2) a(i), range(-1, 2) b(j)), gaps AS (SELECT * FROM e ANTI JOIN cells USING (x, z)),
d AS (SELECT g.x, g.z, c.y, row_number() OVER (PARTITION BY g.x, g.z ORDER BY (g.x - c.x) * (g.x - c.x) + (g.z - c.z) * (g.z - c.z), c.x, c.z) AS rank FROM gaps g, cells c)
SELECT CAST(x AS BIGINT) AS row, CAST(z AS BIGINT) AS col, round(avg(y), 9) AS height FROM d WHERE rank <= 10 GROUP BY x, z""")
def j22(spark, sf_dir):
    cells = raster.occupied(points(spark, sf_dir), 1.0)
    known = cells.select(F.col("row").cast("double").alias("x"), F.col("col").cast("double").alias("z"), F.col("height").alias("y"), (F.col("row") * 1000 + F.col("col")).alias("cell"))
    gaps = raster.subtract(raster.dilate(cells.select("row", "col"), 1), cells).select("row", "col", F.col("row").cast("double").alias("x"), F.col("col").cast("double").alias("z"), (F.col("row") * 1000 + F.col("col")).alias("gap"))
    near = spatial.k_nearest(gaps.select("gap", "x", "z"), known, "gap", "cell", 10, 8.0, (), ("x", "z"))
    return near.join(gaps, "gap").groupBy("row", "col").agg(F.round(F.avg("right.y"), 9).alias("height"))


@REGISTRY.add("j11_camera_room_assignment", f"""WITH {POSES}, {POINTS}, rooms AS (SELECT segment AS room_id, avg(x) AS x, avg(z) AS z FROM points GROUP BY segment),
d AS (SELECT frame_id, room_id, row_number() OVER (PARTITION BY frame_id ORDER BY (p.x - r.x) * (p.x - r.x) + (p.z - r.z) * (p.z - r.z), room_id) AS rank FROM poses p, rooms r WHERE p.y BETWEEN 10 AND 40)
SELECT frame_id, room_id FROM d WHERE rank = 1""")
def j11(spark, sf_dir):
    # a floor's rooms are a stated small set of centres; every camera in the floor's heights is held against it
    rooms = points(spark, sf_dir).groupBy(F.col("segment").alias("room_id")).agg(F.avg("x").alias("rx"), F.avg("z").alias("rz"))
    cameras = poses(spark, sf_dir).where("y between 10 and 40").crossJoin(F.broadcast(rooms))
    dx, dz = F.col("x") - F.col("rx"), F.col("z") - F.col("rz")
    return cameras.groupBy("frame_id").agg(F.min_by("room_id", F.struct((dx * dx + dz * dz).alias("d2"), "room_id")).alias("room_id"))


@REGISTRY.add("j23_nearest_colour", """WITH pal AS (SELECT CAST(n_nationkey AS BIGINT) AS class, n_nationkey * 10 AS r, (n_nationkey * 37) % 256 AS g, (n_nationkey * 91) % 256 AS b FROM nation),
d AS (SELECT p_partkey, class, abs(p_partkey % 256 - r) + abs(p_size * 5 - g) + abs((p_partkey * 7) % 256 - b) AS d FROM part, pal), q AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, class) AS rank FROM d)
SELECT p_partkey, class FROM q WHERE rank = 1""")
def j23(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    palette = table(spark, sf_dir, "nation").select(k.alias("class"), (k * 10).alias("r"), (k * 37 % 256).alias("g"), (k * 91 % 256).alias("b"))
    p = table(spark, sf_dir, "part").crossJoin(F.broadcast(palette))
    d = F.abs(F.col("p_partkey") % 256 - F.col("r")) + F.abs(F.col("p_size") * 5 - F.col("g")) + F.abs(F.col("p_partkey") * 7 % 256 - F.col("b"))
    return p.groupBy("p_partkey").agg(F.min_by("class", F.struct(d.alias("d"), "class")).alias("class"))


@REGISTRY.add("a1_feature_fusion", f"""WITH {POINTS}, hits AS (SELECT frame_id, segment AS map_point, y, z, row_number() OVER (PARTITION BY frame_id, segment ORDER BY point_id DESC, y DESC, z DESC) AS rank FROM points)
SELECT map_point, count(*) AS frames, round(avg(y), 9) AS f0, round(avg(z), 9) AS f1 FROM hits WHERE rank = 1 GROUP BY map_point""")
def a1(spark, sf_dir):
    # point_id is no key: of a frame's rows with the same one, that of largest feature counts
    hits = points(spark, sf_dir).select(F.col("segment").alias("map_point"), "frame_id", F.col("point_id").alias("pixel_id"), F.array("y", "z").alias("embedding"))
    mean = scene.fuse_features(hits)
    return mean.select("map_point", "frames", F.round(F.col("mean_vector")[0], 9).alias("f0"), F.round(F.col("mean_vector")[1], 9).alias("f1"))


@REGISTRY.add("s8_intrinsics", "SELECT p_partkey, round(w / (2 * tan(pi() / 4)), 6) AS fx, round(h / (2 * tan(atan(tan(pi() / 4) * h / w))), 6) AS fy, w / 2 AS cx, h / 2 AS cy FROM (SELECT p_partkey, CAST(p_size + 100 AS DOUBLE) AS w, CAST(p_size + 60 AS DOUBLE) AS h FROM part)")
def s8(spark, sf_dir):
    w, h = (F.col("p_size") + 100).cast("double"), (F.col("p_size") + 60).cast("double")
    fx, fy, cx, cy = G.intrinsics(w, h)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(fx, 6).alias("fx"), F.round(fy, 6).alias("fy"), cx.alias("cx"), cy.alias("cy"))
