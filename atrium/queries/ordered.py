"""Histograms, peaks, floors, sessions and trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import ordered
from .tables import POSES, Registry, poses, table

REGISTRY = Registry()
_HIST = f"{POSES}, hist AS (SELECT CAST(floor(y / 2) AS BIGINT) AS bin, count(*) AS n FROM poses GROUP BY 1)"
_DENSE = f"{_HIST}, dense AS (SELECT b AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT min(bin) FROM hist), (SELECT max(bin) FROM hist) + 1)) AS b) LEFT JOIN hist ON b = bin)"
_SMOOTH = f"""{_DENSE}, w AS (SELECT k, exp(-0.5 * (k / 2.0) * (k / 2.0)) / (SELECT sum(exp(-0.5 * (i / 2.0) * (i / 2.0))) FROM range(-8, 9) t(i)) AS weight FROM range(-8, 9) t(k)),
e AS (SELECT min(bin) AS lo, max(bin) - min(bin) + 1 AS size FROM dense),
q AS (SELECT bin, lo, size, weight, (((bin + k - lo) % (2 * size)) + 2 * size) % (2 * size) AS p FROM dense, w, e),
smooth AS (SELECT q.bin, sum(weight * n) AS smooth FROM q JOIN dense d ON d.bin = lo + CASE WHEN p < size THEN p ELSE 2 * size - 1 - p END GROUP BY q.bin)"""


def _hist(spark, sf_dir):
    return ordered.histogram(poses(spark, sf_dir), F.col("y"), 2.0)


@REGISTRY.add("a7_height_histogram", f"WITH {_HIST} SELECT bin, n FROM hist")
def a7(spark, sf_dir):
    return _hist(spark, sf_dir)


@REGISTRY.add("w1_gaussian_smoothing", f"WITH {_SMOOTH} SELECT bin, round(smooth, 5) AS smooth FROM smooth")
def w1(spark, sf_dir):
    return ordered.gaussian_smooth(ordered.dense(_hist(spark, sf_dir))).select("bin", F.round("smooth", 5).alias("smooth"))


@REGISTRY.add("w2_histogram_peaks", f"""WITH {_SMOOTH}, n AS (SELECT *, lag(smooth) OVER (ORDER BY bin) AS before, lead(smooth) OVER (ORDER BY bin) AS after FROM smooth)
SELECT bin, round(smooth, 5) AS smooth FROM n WHERE smooth > before AND smooth > after AND smooth >= (SELECT quantile_cont(smooth, 0.5) FROM smooth)""")
def w2(spark, sf_dir):
    smooth = ordered.gaussian_smooth(ordered.dense(_hist(spark, sf_dir)))
    high = smooth.agg(F.percentile("smooth", F.lit(0.5)).alias("high"))
    return ordered.local_peaks(smooth.join(F.broadcast(high)), "smooth", F.col("high")).select("bin", F.round("smooth", 5).alias("smooth"))


@REGISTRY.add("a11_height_percentiles", f"WITH {POSES} SELECT user_id, round(quantile_cont(y, 0.9), 6) AS p90, round(avg(y), 6) AS mean, min(y) AS low, max(y) AS high FROM poses GROUP BY user_id")
def a11(spark, sf_dir):
    return poses(spark, sf_dir).groupBy("user_id").agg(F.round(F.percentile("y", F.lit(0.9)), 6).alias("p90"), F.round(F.avg("y"), 6).alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"))


_PEAKS = f"{POSES}, ph AS (SELECT user_id AS scene, floor(y / 20) * 20 AS height, count(*) AS n FROM poses GROUP BY 1, 2), pn AS (SELECT *, lag(n) OVER w AS before, lead(n) OVER w AS after FROM ph WINDOW w AS (PARTITION BY scene ORDER BY height)), peaks AS (SELECT scene, height, n FROM pn WHERE n >= coalesce(before, 0) AND n >= coalesce(after, 0)), ends AS (SELECT user_id AS scene, min(y) AS lo, max(y) AS hi FROM poses GROUP BY 1)"


def _peaks(spark, sf_dir):
    p = poses(spark, sf_dir)
    w = W.partitionBy("scene").orderBy("height")
    h = p.groupBy(F.col("user_id").alias("scene"), (F.floor(F.col("y") / 20) * 20).cast("double").alias("height")).agg(F.count("*").alias("n"))
    peaks = h.withColumn("before", F.lag("n").over(w)).withColumn("after", F.lead("n").over(w)).where((F.col("n") >= F.coalesce("before", F.lit(0))) & (F.col("n") >= F.coalesce("after", F.lit(0)))).select("scene", "height", "n")
    return peaks, p.groupBy(F.col("user_id").alias("scene")).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))


@REGISTRY.add("w4_floor_intervals", f"""WITH {_PEAKS}, g AS (SELECT *, CASE WHEN height - lag(height) OVER (PARTITION BY scene ORDER BY height) > 1 THEN 1 ELSE 0 END AS starts FROM peaks),
c AS (SELECT *, sum(starts) OVER (PARTITION BY scene ORDER BY height) AS cluster FROM g), r AS (SELECT *, max(cluster) OVER (PARTITION BY scene) AS last, row_number() OVER (PARTITION BY scene, cluster ORDER BY n DESC, height) AS rank FROM c),
k AS (SELECT * FROM r WHERE rank <= CASE WHEN cluster IN (0, last) THEN 1 ELSE 2 END), l AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY height) - 1 AS i, lead(height) OVER (PARTITION BY scene ORDER BY height) AS nxt FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY i) - 1 AS floor FROM l WHERE i % 2 = 0 AND nxt IS NOT NULL), t AS (SELECT *, max(floor) OVER (PARTITION BY scene) AS top FROM f),
o AS (SELECT scene, floor, CASE WHEN floor = 0 THEN (height + lo) / 2 ELSE height END AS low, CASE WHEN floor = top THEN (nxt + hi) / 2 ELSE nxt END AS high FROM t JOIN ends USING (scene)
UNION ALL SELECT scene, 0, lo, hi FROM ends WHERE scene NOT IN (SELECT scene FROM f))
SELECT scene, CAST(floor AS INTEGER) AS floor, round(low, 6) AS low, round(high, 6) AS high FROM o""")
def w4(spark, sf_dir):
    return ordered.floor_intervals(*_peaks(spark, sf_dir)).select("scene", F.col("floor").cast("int").alias("floor"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@REGISTRY.add("w5_gap_sessions", f"""WITH {POSES}, g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY user_id ORDER BY y, frame_id) > 1 THEN 1 ELSE 0 END AS starts FROM poses)
SELECT frame_id, user_id, CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY y, frame_id) AS BIGINT) AS cluster FROM g""")
def w5(spark, sf_dir):
    return ordered.sessions(poses(spark, sf_dir), "y", 1.0, ("user_id",), ("frame_id",)).select("frame_id", "user_id", "cluster")


@REGISTRY.add("w6_pose_height_dbscan", f"""WITH {POSES}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY y RANGE BETWEEN 4.0 PRECEDING AND 4.0 FOLLOWING) >= 5 AS core FROM poses),
c AS (SELECT *, lag(y) OVER (PARTITION BY user_id ORDER BY y, frame_id) AS before FROM n WHERE core), s AS (SELECT *, sum(CASE WHEN y - before > 4.0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY y, frame_id) AS id FROM c),
l AS (SELECT n.frame_id, arg_max(s.id, s.y) AS id FROM n JOIN s ON n.user_id = s.user_id AND s.y <= n.y AND n.y - s.y <= 4.0 GROUP BY n.frame_id),
r AS (SELECT n.frame_id, arg_min(s.id, s.y) AS id FROM n JOIN s ON n.user_id = s.user_id AND s.y >= n.y AND s.y - n.y <= 4.0 GROUP BY n.frame_id)
SELECT n.frame_id, CAST(coalesce(l.id, r.id, -1) AS BIGINT) AS cluster FROM n LEFT JOIN l USING (frame_id) LEFT JOIN r USING (frame_id)""")
def w6(spark, sf_dir):
    return ordered.dbscan_1d(poses(spark, sf_dir), "y", 4.0, 5, ("user_id",), ("frame_id",)).select("frame_id", "cluster")


@REGISTRY.add("w7_stair_segments", f"""WITH {POSES}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frame_id) AS i FROM poses), u AS (SELECT *, min(CASE WHEN y > 80 THEN i END) OVER (PARTITION BY user_id) AS stop FROM s),
d AS (SELECT *, max(CASE WHEN y < 20 AND i < stop THEN i END) OVER (PARTITION BY user_id) AS start FROM u) SELECT frame_id, user_id FROM d WHERE start IS NOT NULL AND i BETWEEN start - 5 AND stop + 20""")
def w7(spark, sf_dir):
    return ordered.stair_segment(poses(spark, sf_dir), 20.0, 80.0, keys=("user_id",)).select("frame_id", "user_id")


@REGISTRY.add("w8_pose_edges", f"""WITH {POSES}, l AS (SELECT user_id, lag(frame_id) OVER w AS src, frame_id AS dst, (x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w) AS d2 FROM poses WINDOW w AS (PARTITION BY user_id ORDER BY ts, frame_id))
SELECT user_id, src, dst, round(sqrt(d2), 6) AS dist FROM l WHERE src IS NOT NULL""")
def w8(spark, sf_dir):
    return ordered.step_edges(poses(spark, sf_dir), ("ts", "frame_id"), keys=("user_id",)).select("user_id", "src", "dst", F.round("dist", 6).alias("dist"))


@REGISTRY.add("w10_path_resampling")
def w10(spark, sf_dir):
    return ordered.resample_path(poses(spark, sf_dir).select("user_id", "frame_id", "x", "y", "z"), "frame_id", 200.0, keys=("user_id",))


@REGISTRY.add("w3_top_heights_per_user", f"WITH {POSES}, r AS (SELECT user_id, frame_id, y, row_number() OVER (PARTITION BY user_id ORDER BY y DESC, frame_id) AS rank FROM poses) SELECT user_id, frame_id, y FROM r WHERE rank <= 2")
def w3(spark, sf_dir):
    return ordered.top_per_group(poses(spark, sf_dir), ("user_id",), [F.desc("y"), F.asc("frame_id")], 2).select("user_id", "frame_id", "y")


@REGISTRY.add("f9_major_height_poses", f"""WITH {POSES}, h AS (SELECT user_id, floor(y / 20) AS bin, count(*) AS n FROM poses GROUP BY 1, 2), m AS (SELECT user_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, bin) AS rank FROM h) WHERE rank = 1),
k AS (SELECT p.*, min(y) OVER (PARTITION BY p.user_id) AS low FROM poses p JOIN m ON p.user_id = m.user_id AND floor(y / 20) = bin) SELECT frame_id, user_id, y FROM k WHERE y < low + 5""")
def f9(spark, sf_dir):
    p = poses(spark, sf_dir).withColumn("bin", F.floor(F.col("y") / 20))
    best = p.groupBy("user_id", "bin").count().groupBy("user_id").agg(F.min_by("bin", F.struct(-F.col("count"), F.col("bin"))).alias("bin"))
    kept = p.join(best, ["user_id", "bin"]).withColumn("low", F.min("y").over(W.partitionBy("user_id")))
    return kept.where(F.col("y") < F.col("low") + 5).select("frame_id", "user_id", "y")


@REGISTRY.add("t7_floor_order", "SELECT CAST(r_regionkey AS BIGINT) AS floor_id, row_number() OVER (ORDER BY avg(s_acctbal), r_regionkey) AS rank FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_regionkey")
def t7(spark, sf_dir):
    joined = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    level = joined.groupBy(F.col("n_regionkey").cast("long").alias("floor_id")).agg(F.avg("s_acctbal").alias("level"))
    return level.select("floor_id", F.row_number().over(W.orderBy("level", "floor_id")).cast("long").alias("rank"))
