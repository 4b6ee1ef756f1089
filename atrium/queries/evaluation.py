"""Predicted against true rooms and objects, in scenes whose number grows with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, metrics
from ..plans import evaluation
from .tables import POINTS, Registry, points, scene_of, table

REGISTRY = Registry()

# Scenes are suppliers; a predicted object is a third of a scene's points by part, a true one a third by line number.
_SCENES = f"{POINTS}, pts AS (SELECT (point_id // 8) % 10000 AS scene, segment % 3 AS pred_id, point_id % 8 % 3 AS gt_id, point_id, x, y, z FROM points)"
_PERMUTATIONS = "perm AS (SELECT * FROM (VALUES (0, 0, 1, 2), (1, 0, 2, 1), (2, 1, 0, 2), (3, 1, 2, 0), (4, 2, 0, 1), (5, 2, 1, 0)) t(pid, c0, c1, c2))"
_ON = "((pred_id = 0 AND gt_id = c0) OR (pred_id = 1 AND gt_id = c1) OR (pred_id = 2 AND gt_id = c2))"


def _matched(scores: str, value: str) -> str:
    """The best of all six assignments of three predicted to three true nodes of each scene, over a table of scores."""
    return f"""{_PERMUTATIONS}, sums AS (SELECT scene, pid, sum({value}) AS total FROM {scores} JOIN perm ON {_ON} GROUP BY 1, 2), best AS (SELECT scene, arg_max(pid, total) AS pid FROM sums GROUP BY scene),
matched AS (SELECT s.* FROM best JOIN perm USING (pid) JOIN {scores} s ON s.scene = best.scene AND {_ON})"""


_SWEEP = """hits AS (SELECT n.scene, i, sum(CASE WHEN m.overlap > CAST(i AS DOUBLE) / 10 THEN 1 ELSE 0 END)::BIGINT AS tp FROM totals n CROSS JOIN range(0, 11) r(i) LEFT JOIN matched m ON m.scene = n.scene GROUP BY 1, 2),
lagged AS (SELECT h.*, pred, gt, lag(tp) OVER (PARTITION BY h.scene ORDER BY i DESC) AS above FROM hits h JOIN totals USING (scene)),
ap AS (SELECT scene, coalesce(sum((tp - above) / gt * (tp + above) / pred / 2), 0.0) AS ap, max(CASE WHEN i = 5 THEN tp END) AS tp FROM lagged GROUP BY scene)"""
_SHOWN = "scene, pred, gt, round(ap, 6) AS ap, round(tp / (pred + gt - tp), 6) AS acc, round(tp / pred, 6) AS prec, round(tp / gt, 6) AS recall, tp, pred - tp AS fp, gt - tp AS fn"


def _scenes(spark, sf_dir):
    """Points with scene, pred_id and gt_id."""
    p = points(spark, sf_dir)
    return p.select(scene_of(10000).alias("scene"), (F.col("segment") % 3).alias("pred_id"), (F.col("point_id") % 8 % 3).alias("gt_id"), "point_id", "x", "y", "z")


def _shown(df):
    kept = {"scene", "pred", "gt", "tp", "fp", "fn", "pred_id", "gt_id"}
    return df.select(*[F.col(c) if c in kept else F.round(c, 6).alias(c) for c in df.columns])


_IOU = f"""{_SCENES}, pb AS (SELECT scene, pred_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, count(*) AS n FROM pts GROUP BY 1, 2),
gb AS (SELECT scene, gt_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, count(*) AS n FROM pts GROUP BY 1, 2),
iv AS (SELECT p.scene, pred_id, gt_id, p.n AS n_pred, g.n AS n_gt, greatest(0, least(p.x1, g.x1) - greatest(p.x0, g.x0)) * greatest(0, least(p.y1, g.y1) - greatest(p.y0, g.y0)) * greatest(0, least(p.z1, g.z1) - greatest(p.z0, g.z0)) AS inter,
(p.x1 - p.x0) * (p.y1 - p.y0) * (p.z1 - p.z0) AS vp, (g.x1 - g.x0) * (g.y1 - g.y0) * (g.z1 - g.z0) AS vg FROM pb p JOIN gb g ON p.scene = g.scene),
pairs AS (SELECT scene, pred_id, gt_id, n_pred, n_gt, inter / (vp + vg - inter) AS iou FROM iv WHERE inter > 0),
near AS (SELECT a.scene, a.pred_id, b.gt_id, count(DISTINCT a.point_id) AS na, count(DISTINCT b.point_id) AS nb FROM pts a JOIN pts b ON a.scene = b.scene AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.5625 GROUP BY 1, 2, 3),
scores AS (SELECT scene, pred_id, gt_id, iou, greatest(coalesce(na, 0) / n_pred, coalesce(nb, 0) / n_gt) AS overlap, least(1.0, coalesce(nb, 0) / n_pred) AS over_pred, least(1.0, coalesce(na, 0) / n_gt) AS over_gt FROM pairs LEFT JOIN near USING (scene, pred_id, gt_id)),
totals AS (SELECT scene, count(DISTINCT pred_id) AS pred, count(DISTINCT gt_id) AS gt FROM pts GROUP BY 1)"""


@REGISTRY.add("j15_object_pairs", f"WITH {_IOU} SELECT scene, pred_id, gt_id, round(iou, 6) AS iou, round(overlap, 6) AS overlap, round(over_pred, 6) AS over_pred, round(over_gt, 6) AS over_gt FROM scores")
def j15(spark, sf_dir):
    p = _scenes(spark, sf_dir)
    return _shown(evaluation.object_pairs(p.drop("gt_id"), p.drop("pred_id"), 0.75, 8.0))


@REGISTRY.add("e3_object_evaluation", f"WITH {_IOU}, {_matched('scores', 'overlap')}, {_SWEEP} SELECT {_SHOWN} FROM ap JOIN totals USING (scene)")
def e3_objects(spark, sf_dir):
    p = _scenes(spark, sf_dir)
    return _shown(evaluation.object_evaluation(p.drop("gt_id"), p.drop("pred_id"), "overlap", 0.75, 8.0))


# Rooms are seen from above: one cell a part, in scenes of 500 parts; a predicted room is a third of them by size, a true one by key.
_ROOMS = """cells AS (SELECT p_partkey // 500 AS scene, CAST(p_size % 3 AS BIGINT) AS pred_id, CAST((p_partkey * 7) % 11 % 3 AS BIGINT) AS gt_id, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 11 AS DOUBLE) AS y, p_retailprice / 20 AS z FROM part),
fl AS (SELECT scene, 2.2 * r_regionkey AS lower, 2.2 * (r_regionkey + 1) AS upper FROM (SELECT DISTINCT scene FROM cells) CROSS JOIN region),
pr AS (SELECT scene, pred_id, avg(y) AS mid_height FROM cells GROUP BY 1, 2), gr AS (SELECT scene, gt_id, avg(y) AS mean_height, min(y) AS min_height, max(y) AS max_height FROM cells GROUP BY 1, 2),
room_pairs AS (SELECT DISTINCT pr.scene, pred_id, gt_id FROM pr JOIN gr ON pr.scene = gr.scene AND mid_height > min_height AND mid_height < max_height JOIN fl ON fl.scene = gr.scene AND mean_height > lower AND mean_height < upper)"""


def _rooms(spark, sf_dir):
    key = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").select(
        F.floor(key / 500).cast("long").alias("scene"), (F.col("p_size") % 3).cast("long").alias("pred_id"), (key * 7 % 11 % 3).cast("long").alias("gt_id"),
        F.col("p_size").cast("double").alias("x"), (key % 11).cast("double").alias("y"), (F.col("p_retailprice") / 20).alias("z"),
    )
    k = F.col("r_regionkey")
    floors = cells.select("scene").distinct().crossJoin(table(spark, sf_dir, "region").select((2.2 * k).alias("lower"), (2.2 * (k + 1)).alias("upper")))
    pred = cells.join(cells.groupBy("scene", "pred_id").agg(F.avg("y").alias("mid_height")), ["scene", "pred_id"]).drop("gt_id")
    stats = cells.groupBy("scene", "gt_id").agg(F.avg("y").alias("mean_height"), F.min("y").alias("min_height"), F.max("y").alias("max_height"))
    return pred, cells.join(stats, ["scene", "gt_id"]).drop("pred_id"), floors


@REGISTRY.add("j14_room_pairs", f"WITH {_ROOMS} SELECT scene, pred_id, gt_id FROM room_pairs")
def j14(spark, sf_dir):
    pred, gt, floors = _rooms(spark, sf_dir)
    return evaluation.pair_rooms(pred.select("scene", "pred_id", "mid_height").distinct(), gt.select("scene", "gt_id", "mean_height", "min_height", "max_height").distinct(), floors)


@REGISTRY.add("e2_room_evaluation", f"""WITH {_ROOMS}, tp AS (SELECT scene, pred_id, avg(x) AS x, avg(z) AS z FROM cells GROUP BY scene, pred_id, floor(x / 2), floor(z / 2)), tg AS (SELECT scene, gt_id, avg(x) AS x, avg(z) AS z FROM cells GROUP BY scene, gt_id, floor(x / 2), floor(z / 2)),
np AS (SELECT scene, pred_id, count(*) AS n_pred FROM tp GROUP BY 1, 2), ng AS (SELECT scene, gt_id, count(*) AS n_gt FROM tg GROUP BY 1, 2),
near AS (SELECT a.scene, pred_id, gt_id, count(DISTINCT (a.x, a.z)) AS na, count(DISTINCT (b.x, b.z)) AS nb FROM tp a JOIN tg b ON a.scene = b.scene AND (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) < 4.0 GROUP BY 1, 2, 3),
scores AS (SELECT scene, pred_id, gt_id, greatest(coalesce(na, 0) / n_pred, coalesce(nb, 0) / n_gt) AS overlap, least(1.0, coalesce(nb, 0) / n_pred) AS over_pred, least(1.0, coalesce(na, 0) / n_gt) AS over_gt FROM room_pairs LEFT JOIN near USING (scene, pred_id, gt_id) JOIN np USING (scene, pred_id) JOIN ng USING (scene, gt_id)),
totals AS (SELECT scene, count(DISTINCT pred_id) AS pred, count(DISTINCT gt_id) AS gt FROM cells GROUP BY 1), {_matched('scores', 'overlap')}, {_SWEEP},
mp AS (SELECT scene, sum(m) AS p FROM (SELECT scene, pred_id, max(over_pred) AS m FROM scores GROUP BY 1, 2) GROUP BY 1), mg AS (SELECT scene, sum(m) AS g FROM (SELECT scene, gt_id, max(over_gt) AS m FROM scores GROUP BY 1, 2) GROUP BY 1)
SELECT {_SHOWN}, round(coalesce(p, 0) / pred, 6) AS max_prec, round(coalesce(g, 0) / gt, 6) AS max_recall FROM ap JOIN totals USING (scene) LEFT JOIN mp USING (scene) LEFT JOIN mg USING (scene)""")
def e2_rooms(spark, sf_dir):
    return _shown(evaluation.room_evaluation(*_rooms(spark, sf_dir), 2.0))


_SHARED = f"""{_SCENES}, n AS (SELECT scene, pred_id, gt_id, count(*) AS n FROM pts GROUP BY 1, 2, 3),
scores AS (SELECT *, n / (sum(n) OVER (PARTITION BY scene, pred_id) + sum(n) OVER (PARTITION BY scene, gt_id) - n) AS score FROM n)"""


def _shared(spark, sf_dir):
    """Points that a predicted and a true object share, over those of both."""
    n = _scenes(spark, sf_dir).groupBy("scene", "pred_id", "gt_id").agg(F.count("*").alias("n"))
    total = lambda c: n.groupBy("scene", c).agg(F.sum("n").alias(f"{c}_n"))
    both = n.join(total("pred_id"), ["scene", "pred_id"]).join(total("gt_id"), ["scene", "gt_id"])
    return both.select("scene", "pred_id", "gt_id", (F.col("n") / (F.col("pred_id_n") + F.col("gt_id_n") - F.col("n"))).alias("score"))


@REGISTRY.add("e3_score_matrix", f"WITH {_SHARED} SELECT scene, pred_id, gt_id, round(score, 6) AS score FROM scores")
def e3(spark, sf_dir):
    return _shown(_shared(spark, sf_dir))


@REGISTRY.add("j24_matched_objects", f"WITH {_SHARED}, {_matched('scores', 'score')} SELECT scene, pred_id, gt_id, round(score, 6) AS score FROM matched")
def j24(spark, sf_dir):
    return _shown(matching.match(_shared(spark, sf_dir), ("scene",), "pred_id", "gt_id"))


@REGISTRY.add("e2_threshold_sweep", f"""WITH {_SHARED}, {_matched('scores', 'score')}, sizes AS (SELECT 3 * count(DISTINCT scene) AS total FROM pts)
SELECT CAST(i AS DOUBLE) / 10 AS threshold, sum(CASE WHEN score > CAST(i AS DOUBLE) / 10 THEN 1 ELSE 0 END)::BIGINT AS tp, round(sum(CASE WHEN score > CAST(i AS DOUBLE) / 10 THEN 1 ELSE 0 END) / max(total), 6) AS precision,
round(sum(CASE WHEN score > CAST(i AS DOUBLE) / 10 THEN 1 ELSE 0 END) / max(total), 6) AS recall FROM matched, sizes, range(0, 11) r(i) GROUP BY i""")
def e2(spark, sf_dir):
    matched = matching.match(_shared(spark, sf_dir), ("scene",), "pred_id", "gt_id")
    n = 3 * _scenes(spark, sf_dir).select("scene").distinct().count()
    return metrics.threshold_sweep(matched, n, n).select("threshold", "tp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@REGISTRY.add("e1_floor_evaluation", """WITH h AS (SELECT user_id % 20 AS scene, user_id // 20 % 4 AS floor, event_id % 2 AS half, value AS y FROM events), b AS (SELECT scene, floor, half, min(y) AS low, max(y) AS high FROM h GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY scene, half ORDER BY low, high) AS rank FROM b), j AS (SELECT coalesce(p.scene, g.scene) AS scene, p.low AS pl, g.low AS gl, abs(p.low - g.low) < 0.5 AND abs(p.high - g.high) < 0.5 AS ok FROM (SELECT * FROM r WHERE half = 0) p FULL JOIN (SELECT * FROM r WHERE half = 1) g ON p.scene = g.scene AND p.rank = g.rank)
SELECT scene, count(pl) AS n_pred, count(gl) AS n_gt, coalesce(sum(CAST(ok AS INTEGER)), 0)::BIGINT AS tp, round(coalesce(sum(CAST(ok AS INTEGER)), 0) / count(pl), 6) AS precision, round(coalesce(sum(CAST(ok AS INTEGER)), 0) / count(gl), 6) AS recall,
round(coalesce(sum(CAST(ok AS INTEGER)), 0) / greatest(count(pl), count(gl)), 6) AS accuracy FROM j GROUP BY scene""")
def e1(spark, sf_dir):
    # one half of the events bounds the predicted floors, the other half the true ones
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("scene"), (F.floor(F.col("user_id") / 20) % 4).alias("floor"), (F.col("event_id") % 2).alias("half"), F.col("value").alias("y"))
    b = e.groupBy("scene", "floor", "half").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    one = metrics.floor_evaluation(b.where("half = 0"), b.where("half = 1"), keys=("scene",))
    return one.select("scene", "n_pred", "n_gt", F.col("tp").cast("long").alias("tp"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy")])
