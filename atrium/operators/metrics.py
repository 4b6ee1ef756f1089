"""Segmentation and detection metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def confusion(df: DataFrame, pred: str, gt: str) -> DataFrame:
    """pred, gt, n: all metrics follow from this table, one row a pair of classes."""
    return df.groupBy(F.col(pred).alias("pred"), F.col(gt).alias("gt")).agg(F.count("*").alias("n"))


def check_sizes(pred: DataFrame, gt: DataFrame, keys: tuple[str, ...]) -> None:
    """Raise if a key (an image, a scene) has other numbers of predicted and of true rows."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    unlike = count(pred, "n_pred").join(count(gt, "n_gt"), list(keys), "full").where("not n_pred <=> n_gt").head()
    if unlike is not None:
        raise ValueError(f"predicted and true sizes differ: {unlike.asDict()}")


def per_class(conf: DataFrame, ignore: tuple = ()) -> DataFrame:
    """class, tp, t (rows of the true class), p (rows predicted), iou; an ignored class has iou 0."""
    true = conf.groupBy(F.col("gt").alias("class")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("pred") == F.col("gt"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = conf.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("p"))
    both = true.join(predicted, "class", "full").fillna(0, ["t", "tp", "p"])
    union = F.col("t") + F.col("p") - F.col("tp")
    iou = F.col("tp") / union
    return both.withColumn("iou", (F.when(~F.col("class").isin(list(ignore)), iou).otherwise(F.lit(0.0)) if ignore else iou))


def segmentation_summary(conf: DataFrame, ignore: tuple = ()) -> DataFrame:
    """One row: pixel_accuracy, mean_accuracy, mean_iou, fw_iou.

    Means divide by the true classes that aren't ignored; frequency weights by
    the true rows that aren't ignored.
    """
    c = per_class(conf, ignore)
    kept = F.lit(True) if not ignore else ~F.col("class").isin(list(ignore))
    real = (F.col("t") > 0) & kept
    n_classes, pixels = F.sum(F.when(real, 1).otherwise(0)), F.sum(F.when(real, F.col("t")).otherwise(0))
    return c.agg(
        (F.sum(F.when(real, F.col("tp")).otherwise(0)) / pixels).alias("pixel_accuracy"),
        (F.sum(F.when(real, F.col("tp") / F.col("t")).otherwise(0.0)) / n_classes).alias("mean_accuracy"),
        (F.sum("iou") / n_classes).alias("mean_iou"),
        (F.sum(F.when(real, F.col("t") * F.col("iou")).otherwise(0.0)) / pixels).alias("fw_iou"),
    )


def threshold_sweep(matched: DataFrame, n_pred: int, n_gt: int, steps: int = 11, value: str = "score") -> DataFrame:
    """threshold, tp, precision, recall for thresholds 0, 1/(steps-1), ..., 1; a pair counts if its score exceeds the threshold."""
    levels = [i / (steps - 1) for i in range(steps)]
    row = matched.agg(F.array(*[F.struct(F.lit(t).alias("threshold"), F.coalesce(F.sum((F.col(value) > t).cast("long")), F.lit(0)).alias("tp")) for t in levels]).alias("rows"))
    return row.select(F.inline("rows")).withColumn("precision", F.col("tp") / F.lit(n_pred)).withColumn("recall", F.col("tp") / F.lit(n_gt))


def area_under(curve: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Trapezoid integral of y over x in ascending x."""
    w = W.partitionBy(*keys).orderBy(x, y)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return curve.withColumn("part", part).groupBy(*keys).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("area"))


def floor_evaluation(pred: DataFrame, gt: DataFrame, tolerance: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n_pred, n_gt, tp, precision, recall, accuracy: floors of a scene aligned by rank of their lower bound.

    A predicted floor is right if both bounds are nearer than the tolerance.
    """
    w = W.partitionBy(*keys).orderBy("low", "high")
    rank = lambda df, c: df.select(*keys, F.row_number().over(w).alias("rank"), F.col("low").alias(f"{c}_low"), F.col("high").alias(f"{c}_high"))
    both = rank(pred, "pred").join(rank(gt, "gt"), [*keys, "rank"], "full")
    right = (F.abs(F.col("pred_low") - F.col("gt_low")) < tolerance) & (F.abs(F.col("pred_high") - F.col("gt_high")) < tolerance)
    out = both.groupBy(*keys).agg(F.count("pred_low").alias("n_pred"), F.count("gt_low").alias("n_gt"), F.coalesce(F.sum(right.cast("int")), F.lit(0)).alias("tp"))
    return out.withColumn("precision", F.col("tp") / F.col("n_pred")).withColumn("recall", F.col("tp") / F.col("n_gt")).withColumn("accuracy", F.col("tp") / F.greatest("n_pred", "n_gt"))


def top_k_accuracy(scored: DataFrame, item: str, label: str, truth: str, ks: tuple[int, ...]) -> DataFrame:
    """k, accuracy: share of items whose true label is among the k of largest sim."""
    w = W.partitionBy(item).orderBy(F.desc("sim"), label)
    rank = scored.withColumn("rank", F.row_number().over(w)).where(F.col(label) == F.col(truth)).select("rank")
    total = scored.agg(F.countDistinct(item).alias("total"))
    levels = scored.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    hits = rank.agg(*[F.sum((F.col("rank") <= k).cast("int")).alias(str(k)) for k in ks]).unpivot([], [str(k) for k in ks], "k", "hits").select(F.col("k").cast("int").alias("k"), "hits")
    return levels.join(hits, "k").join(F.broadcast(total)).select("k", (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("accuracy"))
