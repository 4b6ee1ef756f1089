"""Clusters, components, navigation graphs and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering, graph, ordered, raster
from .tables import POINTS, POSES, Registry, objects, points, poses, table

REGISTRY = Registry()
_LINES = "e AS (SELECT DISTINCT o_custkey AS src, 1000000000000 + l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _bipartite(spark, sf_dir):
    """Customers and suppliers linked by order lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000000000).alias("dst")).distinct()


def _supplied(spark, sf_dir):
    """Orders linked with their suppliers."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_suppkey") + 1000000000000).alias("dst"), F.lit(1.0).alias("dist")).distinct()


@REGISTRY.add("g3_components", f"""WITH {POSES}, s AS (SELECT user_id, frame_id, ts, CASE WHEN abs(y - lag(y) OVER w) <= 60 THEN 0 ELSE 1 END AS starts FROM poses WINDOW w AS (PARTITION BY user_id ORDER BY ts, frame_id)),
g AS (SELECT user_id, frame_id, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, frame_id) AS run FROM s) SELECT frame_id AS id, min(frame_id) OVER (PARTITION BY user_id, run) AS component FROM g""")
def g3(spark, sf_dir):
    # steps of a walk that change the height by at most 60 link its poses
    p = poses(spark, sf_dir)
    steps = ordered.step_edges(p, ("ts", "frame_id"), ("y",), ("user_id",)).where("dist <= 60")
    return graph.components(p.select(F.col("frame_id").alias("id")), steps.select("src", "dst"))


@REGISTRY.add("g11_degrees", f"WITH {_LINES}, bi AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src AS id, count(*) AS degree FROM bi GROUP BY src")
def g11(spark, sf_dir):
    return graph.degrees(_bipartite(spark, sf_dir))


@REGISTRY.add("g12_trimmed_graph", """WITH e AS (SELECT DISTINCT l_orderkey AS src, 1000000000000 + l_suppkey AS dst FROM lineitem) SELECT src, dst, 1.0::DOUBLE AS dist FROM e WHERE src IN (SELECT src FROM e GROUP BY src HAVING count(*) > 1)""")
def g12(spark, sf_dir):
    # an order of one supplier is a leaf; suppliers have so many orders that none becomes one
    return graph.trim(_supplied(spark, sf_dir))


@REGISTRY.add("g11_contracted_chains", """WITH e AS (SELECT DISTINCT l_orderkey AS src, 1000000000000 + l_suppkey AS dst FROM lineitem), d AS (SELECT src, count(*) AS n, min(dst) AS a, max(dst) AS b FROM e GROUP BY src)
SELECT a AS src, b AS dst, 2.0::DOUBLE AS dist, 2::BIGINT AS hops FROM d WHERE n = 2 UNION ALL SELECT src, dst, 1.0, 1 FROM e JOIN d USING (src) WHERE n <> 2""")
def g11_chains(spark, sf_dir):
    # an order of two suppliers is the middle of a chain between them
    return graph.contract_chains(_supplied(spark, sf_dir))


@REGISTRY.add("g11_resampled_chains")
def g11_resampled(spark, sf_dir):
    steps = ordered.step_edges(poses(spark, sf_dir), ("ts", "frame_id"), keys=("user_id",))
    return graph.resample_chains(steps.select("src", "dst", "dist"), 200.0).withColumn("dist", F.round("dist", 6))


@REGISTRY.add("g2_point_clusters")
def g2(spark, sf_dir):
    p = points(spark, sf_dir)
    found = clustering.dbscan(p, "point_id", 1.5, 4, ("segment",))
    return p.join(found, ["segment", "point_id"]).select("point_id", "segment", "cluster")


@REGISTRY.add("g1_segment_features")
def g1(spark, sf_dir):
    return clustering.mask_features(objects(spark, sf_dir), "room_id", "vec_id", 0.5, 3)


@REGISTRY.add("g7_room_views")
def g7(spark, sf_dir):
    return clustering.view_representatives(objects(spark, sf_dir), "room_id", "vec_id", 5)


@REGISTRY.add("g4_merged_segments")
def g4(spark, sf_dir):
    # two passes over the scene see each cell of space as a segment of their own
    p = points(spark, sf_dir)
    cell = (F.floor(F.col("x") / 5) * 100 + F.floor(F.col("y") / 2)) * 100 + F.floor(F.col("z") / 10)
    return clustering.merge_masks(p.withColumn("segment", (cell * 2 + F.col("frame_id") % 2).cast("long")), "segment", "point_id", 0.5, 0.5, 0.5, 0.25, 10.0)


_CELLS = f"{POINTS}, c AS (SELECT DISTINCT segment, CAST(floor(x / 2) AS BIGINT) AS row, CAST(floor(z / 2) AS BIGINT) AS col FROM points)"


def _cells(spark, sf_dir):
    return raster.occupied(points(spark, sf_dir), 2.0, ("segment",)).select("segment", "row", "col")


@REGISTRY.add("w9_dilated_cells", f"WITH {_CELLS} SELECT DISTINCT segment, row + i AS row, col + j AS col FROM c, range(-1, 2) a(i), range(-1, 2) b(j)")
def w9_dilate(spark, sf_dir):
    return raster.dilate(_cells(spark, sf_dir), 1, ("segment",))


@REGISTRY.add("w9_closed_cells", f"""WITH {_CELLS}, d AS (SELECT DISTINCT segment, row + i AS row, col + j AS col FROM c, range(-1, 2) a(i), range(-1, 2) b(j)), s AS (SELECT segment, row + i AS row, col + j AS col FROM d, range(-1, 2) a(i), range(-1, 2) b(j))
SELECT segment, row, col FROM s GROUP BY segment, row, col HAVING count(*) = 9""")
def w9_close(spark, sf_dir):
    return raster.close(_cells(spark, sf_dir), 1, ("segment",))


@REGISTRY.add("w9_box_mean", f"""WITH {POINTS}, c AS (SELECT segment, CAST(floor(x / 2) AS BIGINT) AS row, CAST(floor(z / 2) AS BIGINT) AS col, max(y) AS height FROM points GROUP BY 1, 2, 3)
SELECT a.segment, a.row, a.col, round(avg(b.height), 6) AS height FROM c a JOIN c b ON a.segment = b.segment AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3""")
def w9_mean(spark, sf_dir):
    cells = raster.occupied(points(spark, sf_dir), 2.0, ("segment",))
    return raster.box_mean(cells, 1, "height", ("segment",)).select("segment", "row", "col", F.round("height", 6).alias("height"))


@REGISTRY.add("s9_free_cells", f"""WITH {POINTS}, c AS (SELECT DISTINCT CAST(floor(x / 0.05) AS BIGINT) AS row, CAST(floor(z / 0.05) AS BIGINT) AS col, y < 9 AS low FROM points)
SELECT row, col FROM c WHERE low EXCEPT SELECT row, col FROM c WHERE NOT low""")
def s9(spark, sf_dir):
    p = points(spark, sf_dir)
    low, high = (raster.occupied(p.where(c), 0.05).select("row", "col") for c in ("y < 9", "not y < 9"))
    return raster.subtract(low, high)


@REGISTRY.add("t9_cell_components")
def t9(spark, sf_dir):
    return raster.cell_components(_cells(spark, sf_dir), ("segment",))


@REGISTRY.add("g9_rooms")
def g9(spark, sf_dir):
    region = raster.close(raster.occupied(points(spark, sf_dir), 1.0).select("row", "col"), 2)
    return raster.segment_rooms(region, 3.0)


@REGISTRY.add("g10_medial_axis")
def g10(spark, sf_dir):
    region = raster.close(raster.occupied(points(spark, sf_dir), 1.0).select("row", "col"), 1)
    return raster.medial_edges(raster.nearest_wall(region), 3.0)


@REGISTRY.add("g9_otsu_threshold", f"""WITH {POINTS}, h AS (SELECT segment, CAST(floor(z) AS BIGINT) AS bin, count(*) AS n FROM points GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER w AS w0, sum(bin * n) OVER w AS m0, sum(n) OVER p - sum(n) OVER w AS w1, sum(bin * n) OVER p - sum(bin * n) OVER w AS m1 FROM h WINDOW w AS (PARTITION BY segment ORDER BY bin), p AS (PARTITION BY segment)),
b AS (SELECT segment, bin, CAST(w0 AS DOUBLE) * w1 * (m0 / w0 - m1 / w1) * (m0 / w0 - m1 / w1) AS between_var FROM s WHERE w1 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY between_var DESC, bin) AS rank FROM b)
SELECT segment, bin AS threshold FROM r WHERE rank = 1""")
def g9_otsu(spark, sf_dir):
    h = points(spark, sf_dir).groupBy("segment", F.floor("z").cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return raster.otsu(h, ("segment",))
