"""Predicted rooms and objects against the true ones, scene by scene.

Pairs meet by scene keys and ranges, overlaps by grid cells; what is matched in
one group is a scene's table of predicted against true nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import matching, metrics, spatial


def pair_rooms(pred: DataFrame, gt: DataFrame, floors: DataFrame, keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """keys, pred_id, gt_id: the rooms that are compared.

    A true room counts if its mean height lies within a true floor, and meets
    the predicted rooms whose middle height lies within its own heights; all
    bounds are strict.  pred: pred_id, mid_height; gt: gt_id, mean_height,
    min_height, max_height; floors: lower, upper.
    """
    names = list(keys)
    inside = (F.col("mean_height") > F.col("lower")) & (F.col("mean_height") < F.col("upper"))
    on_floor = gt.join(floors.select(*names, "lower", "upper"), names).where(inside).select(*names, "gt_id", "min_height", "max_height").distinct()
    met = (F.col("mid_height") > F.col("min_height")) & (F.col("mid_height") < F.col("max_height"))
    return pred.join(on_floor, names).where(met).select(*names, "pred_id", "gt_id").distinct()


def score_pairs(pred: DataFrame, gt: DataFrame, pairs: DataFrame, radius: float, keys: tuple[str, ...] = ("scene",), axes: tuple[str, ...] = spatial.AXES) -> DataFrame:
    """pairs with overlap (the larger of both shares of near points), over_pred and over_gt (one-sided shares, at most 1).

    pred: keys, pred_id, point_id and axes; gt: keys, gt_id, point_id and axes.
    over_pred has the true points near the prediction over its points.
    """
    names = list(keys)
    near = spatial.near_counts(pred, gt, "pred_id", "gt_id", "point_id", radius, keys, axes)
    n_pred = pred.groupBy(*names, "pred_id").agg(F.count("*").alias("n_pred"))
    n_gt = gt.groupBy(*names, "gt_id").agg(F.count("*").alias("n_gt"))
    both = pairs.join(near, [*names, "pred_id", "gt_id"], "left").fillna(0, ["na", "nb"]).join(n_pred, [*names, "pred_id"]).join(n_gt, [*names, "gt_id"])
    share = lambda n, total: F.col(n) / F.col(total)
    at_most_1 = lambda c: F.least(F.lit(1.0), c)
    return both.select(
        *pairs.columns, F.greatest(share("na", "n_pred"), share("nb", "n_gt")).alias("overlap"),
        at_most_1(share("nb", "n_pred")).alias("over_pred"), at_most_1(share("na", "n_gt")).alias("over_gt"),
    )


def object_pairs(pred: DataFrame, gt: DataFrame, radius: float = 0.02, cell: float = 1.0, keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """keys, pred_id, gt_id, iou, overlap, over_pred, over_gt of the objects whose boxes meet: filter by box, refine by points."""
    names = list(keys)
    boxes = lambda df, c: spatial.bounds(df, (*keys, c))
    met = spatial.box_pairs(boxes(pred, "pred_id"), boxes(gt, "gt_id"), "pred_id", "gt_id", cell, 0.0, keys)
    return score_pairs(pred, gt, met.select(*names, "pred_id", "gt_id", "iou"), radius, keys)


def sizes(pred: DataFrame, gt: DataFrame, keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """keys, pred, gt: the number of predicted and of true nodes."""
    names = list(keys)
    p = pred.groupBy(*names).agg(F.countDistinct("pred_id").alias("pred"))
    g = gt.groupBy(*names).agg(F.countDistinct("gt_id").alias("gt"))
    return p.join(g, names, "full").fillna(0, ["pred", "gt"])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def average_precision(scores: DataFrame, totals: DataFrame, keys: tuple[str, ...] = ("scene",), value: str = "overlap", match_by: str = "", at: float = 0.5, steps: int = 11) -> DataFrame:
    """keys, pred, gt, ap, acc, prec, recall, tp, fp, fn of the best matching.

    Nodes are matched for the largest sum of ``match_by`` (``value`` by default);
    a matched pair is right at a threshold if its value exceeds it.  ap is the
    area under precision over recall for thresholds 0 to 1; the others are
    those at the threshold ``at``.
    """
    names = list(keys)
    pairs = matching.match(scores, keys, "pred_id", "gt_id", match_by or value)
    matched = pairs.select(*names, "pred_id", "gt_id").join(scores.select(*names, "pred_id", "gt_id", value), [*names, "pred_id", "gt_id"])
    over = lambda t: F.sum((F.col(value) > t).cast("long"))
    # from the highest threshold down, so that recall rises
    hits = F.array(*[over(i / (steps - 1)) for i in reversed(range(steps))])
    found = matched.groupBy(*names).agg(hits.alias("hits"), over(at).alias("tp"))
    row = totals.join(found, names, "left").withColumn("tp", F.coalesce("tp", F.lit(0).cast("long"))).withColumn("hits", F.coalesce("hits", F.array(*[F.lit(0).cast("long")] * steps)))
    prec = lambda tp: _ratio(tp, F.col("pred"))
    recall = lambda tp: _ratio(tp, F.col("gt"))
    area = F.lit(0.0)
    for i in range(1, steps):
        a, b = F.col("hits")[i - 1], F.col("hits")[i]
        area = area + (recall(b) - recall(a)) * (prec(a) + prec(b)) / 2
    tp = F.col("tp")
    return row.select(
        *names, "pred", "gt", area.alias("ap"), _ratio(tp, F.col("pred") + F.col("gt") - tp).alias("acc"), prec(tp).alias("prec"), recall(tp).alias("recall"),
        "tp", (F.col("pred") - tp).alias("fp"), (F.col("gt") - tp).alias("fn"),
    )


def best_overlaps(scores: DataFrame, totals: DataFrame, keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """keys, max_prec, max_recall: means over predicted (true) nodes of their largest one-sided share; a node without a pair counts 0."""
    names = list(keys)
    best = lambda node, share: scores.groupBy(*names, node).agg(F.max(share).alias("best")).groupBy(*names).agg(F.sum("best").alias(share))
    both = totals.join(best("pred_id", "over_pred"), names, "left").join(best("gt_id", "over_gt"), names, "left").fillna(0.0, ["over_pred", "over_gt"])
    return both.select(*names, _ratio(F.col("over_pred"), F.col("pred")).alias("max_prec"), _ratio(F.col("over_gt"), F.col("gt")).alias("max_recall"))


def room_evaluation(pred: DataFrame, gt: DataFrame, floors: DataFrame, size: float = 0.05, keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """average_precision and best_overlaps of rooms, seen from above.

    pred: keys, pred_id, mid_height, x, z; gt: keys, gt_id, min_height,
    max_height, mean_height, x, z, both a row a point.  Points are thinned to
    one mean a cell of ``size`` in x and z, which is also the radius of overlap.
    """
    flat = ("x", "z")
    thin = lambda df, c: spatial.voxel_downsample(df, size, (*keys, c), flat, flat).withColumn("point_id", F.struct("vx", "vz"))
    rooms = lambda df, c, *more: df.groupBy(*keys, c).agg(*[F.first(m).alias(m) for m in more])
    pairs = pair_rooms(rooms(pred, "pred_id", "mid_height"), rooms(gt, "gt_id", "mean_height", "min_height", "max_height"), floors, keys)
    scores = score_pairs(thin(pred, "pred_id"), thin(gt, "gt_id"), pairs, size, keys, flat)
    totals = sizes(pred, gt, keys)
    return average_precision(scores, totals, keys).join(best_overlaps(scores, totals, keys), list(keys))


def object_evaluation(pred: DataFrame, gt: DataFrame, metric: str = "overlap", radius: float = 0.02, cell: float = 1.0, keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """average_precision of objects by overlap; metric: "overlap" or "iou", by which they are matched.

    pred: keys, pred_id, point_id, x, y, z; gt: keys, gt_id, point_id, x, y, z.
    """
    scores = object_pairs(pred, gt, radius, cell, keys)
    return average_precision(scores, sizes(pred, gt, keys), keys, "overlap", metric)
