"""Operators on ordered data: histograms, smoothing, peaks, sessions and trajectories."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def histogram(df: DataFrame, value: Column, width: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """bin (floor of value over width) and n, per keys; empty bins have no row."""
    return df.groupBy(*keys, F.floor(value / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, a: Column, b: Column, width: float, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys, F.floor(a / width).cast("long").alias("row"), F.floor(b / width).cast("long").alias("col")).agg(F.count("*").alias("n"))


def dense(hist: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All bins between a key's first and last, with n = 0 where there was none."""
    span = hist.groupBy(*keys).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).select(*keys, F.explode(F.sequence("lo", "hi")).alias("bin"))
    return span.join(hist, [*keys, "bin"], "left").fillna(0, ["n"])


def gaussian_smooth(hist: DataFrame, sigma: float = 2.0, truncate: float = 4.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Gaussian filter of dense bins with reflected borders: the border bin repeats beyond the border."""
    reach = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(weights)
    span = hist.groupBy(*keys).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    source = hist.select(*keys, F.col("bin").alias("at"), "n")
    # each bin adds to its neighbours, and again to those that see it mirrored in a border
    size = F.col("hi") - F.col("lo") + 1
    spread = hist.join(span, list(keys)) if keys else hist.crossJoin(F.broadcast(span))
    spread = spread.select(*keys, "bin", "lo", "hi", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(weights[k + reach] / total).alias("weight")) for k in range(-reach, reach + 1)])).alias("o"))
    # position p reflects with period 2 * size: p -> p or 2 * size - 1 - p
    p = F.pmod(F.col("bin") + F.col("o.k") - F.col("lo"), 2 * size)
    spread = spread.select(*keys, "bin", (F.col("lo") + F.when(p < size, p).otherwise(2 * size - 1 - p)).alias("at"), F.col("o.weight").alias("weight"))
    return spread.join(source, [*keys, "at"]).groupBy(*keys, "bin").agg(F.sum(F.col("weight") * F.col("n")).alias("smooth")).join(hist, [*keys, "bin"])


def local_peaks(series: DataFrame, value: str, height: Column | float, distance: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Bins above both neighbours and at least ``height``; of peaks nearer than ``distance`` bins the higher stays."""
    w = W.partitionBy(*keys).orderBy("bin")
    height = F.lit(height) if isinstance(height, (int, float)) else height
    peaks = series.withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w)).where((F.col(value) > F.col("before")) & (F.col(value) > F.col("after")) & (F.col(value) >= height)).drop("before", "after")
    if distance <= 1:
        return peaks

    def suppress(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        for i in np.lexsort((pdf["bin"], -pdf[value])):
            if all(abs(pdf["bin"].iat[i] - pdf["bin"].iat[j]) >= distance for j in kept):
                kept.append(i)
        return pdf.iloc[sorted(kept)]

    grouped = peaks.groupBy(*keys) if keys else peaks.groupBy(F.lit(0))
    return grouped.applyInPandas(suppress, peaks.schema)


def sessions(df: DataFrame, value: str, eps: float, keys: tuple[str, ...] = (), tie: tuple[str, ...] = ()) -> DataFrame:
    """1-D DBSCAN with min_samples = 1: a new cluster starts after a gap above eps."""
    w = W.partitionBy(*keys).orderBy(value, *tie)
    gap = F.col(value) - F.lag(value).over(w)
    return df.withColumn("starts", F.when(gap > eps, 1).otherwise(0)).withColumn("cluster", F.sum("starts").over(w).cast("long")).drop("starts")


def dbscan_1d(df: DataFrame, value: str, eps: float, min_points: int, keys: tuple[str, ...] = (), tie: tuple[str, ...] = ()) -> DataFrame:
    """1-D DBSCAN: cluster of core points by gaps, of border points by the nearest core to the left, else right; noise is -1."""
    by = f"PARTITION BY {', '.join(keys)} " if keys else ""
    near = F.expr(f"count(*) OVER ({by}ORDER BY {value} RANGE BETWEEN {float(eps)}D PRECEDING AND {float(eps)}D FOLLOWING)")
    w = W.partitionBy(*keys).orderBy(value, *tie)
    out = df.withColumn("core", near >= min_points).withColumn("core_at", F.when(F.col("core"), F.col(value)))
    before = F.last("core_at", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    out = out.withColumn("gap", F.when(F.col("core"), F.coalesce(F.col(value) - before, F.lit(0.0)))).withColumn("id", F.sum(F.when(F.col("gap") > eps, 1).otherwise(0)).over(w).cast("long"))
    left_at, left_id = (F.last(F.when(F.col("core"), F.col(c)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)) for c in (value, "id"))
    right_at, right_id = (F.first(F.when(F.col("core"), F.col(c)), ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)) for c in (value, "id"))
    cluster = F.when(F.col(value) - left_at <= eps, left_id).when(right_at - F.col(value) <= eps, right_id).otherwise(F.lit(-1))
    return out.withColumn("cluster", cluster.cast("long")).drop("core_at", "gap", "id")


def top_per_group(df: DataFrame, keys: tuple[str, ...], order: list[Column], n: Column | int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def floor_intervals(peaks: DataFrame, bounds: DataFrame, at: str = "height", keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """Floors from peaks of the height histogram.

    Peaks within 1 of each other form clusters; the outer clusters keep their
    highest peak and inner ones their two highest.  Peaks 0-1, 2-3, ... bound
    floors, and the outer bounds move halfway to the data's least and largest
    height.  A scene with a single cluster is one floor over all its data.
    peaks: keys, ``at`` and n; bounds: keys, lo, hi.
    """
    clustered = sessions(peaks, at, 1.0, keys)
    w = W.partitionBy(*keys)
    clustered = clustered.withColumn("last", F.max("cluster").over(w))
    kept = top_per_group(clustered, (*keys, "cluster"), [F.desc("n"), F.asc(at)], F.when((F.col("cluster") == 0) | (F.col("cluster") == F.col("last")), 1).otherwise(2))
    order = w.orderBy(at)
    lined = kept.withColumn("i", F.row_number().over(order) - 1).withColumn("next", F.lead(at).over(order)).where((F.col("i") % 2 == 0) & F.col("next").isNotNull())
    floors = lined.withColumn("floor", F.row_number().over(w.orderBy("i")) - 1).withColumn("top", F.max("floor").over(w)).join(bounds, list(keys))
    floors = floors.select(*keys, "floor", F.when(F.col("floor") == 0, (F.col(at) + F.col("lo")) / 2).otherwise(F.col(at)).alias("low"), F.when(F.col("floor") == F.col("top"), (F.col("next") + F.col("hi")) / 2).otherwise(F.col("next")).alias("high"))
    alone = bounds.join(floors.select(*keys).distinct(), list(keys), "left_anti").select(*keys, F.lit(0).alias("floor"), F.col("lo").alias("low"), F.col("hi").alias("high"))
    return floors.unionByName(alone)


def stair_segment(poses: DataFrame, low: Column | float, high: Column | float, order: str = "frame_id", height: str = "y", before: int = 5, after: int = 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """The frames from the last dip below ``low`` before the first rise above ``high``, with margins; none without a crossing."""
    w = W.partitionBy(*keys)
    seq = poses.withColumn("i", F.row_number().over(w.orderBy(order)))
    up = seq.withColumn("end", F.min(F.when(F.col(height) > high, F.col("i"))).over(w))
    up = up.withColumn("start", F.max(F.when((F.col(height) < low) & (F.col("i") < F.col("end")), F.col("i"))).over(w))
    return up.where(F.col("start").isNotNull() & F.col("i").between(F.col("start") - before, F.col("end") + after)).drop("start", "end", "i")


def step_edges(poses: DataFrame, order: tuple[str, ...], axes: tuple[str, ...] = ("x", "y", "z"), keys: tuple[str, ...] = (), node: str = "frame_id") -> DataFrame:
    """Edges between consecutive poses with the length of the step."""
    w = W.partitionBy(*keys).orderBy(*order)
    total = F.lit(0.0)
    for a in axes:
        d = F.col(a) - F.lag(a).over(w)
        total = total + d * d
    return poses.select(*keys, F.lag(node).over(w).alias("src"), F.col(node).alias("dst"), F.sqrt(total).alias("dist")).where("src is not null")


def resample_path(path: DataFrame, order: str, step: float, axes: tuple[str, ...] = ("x", "y", "z"), keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """The first point of each path and each point at which more than ``step`` has been walked since the last one kept.

    Paths stream in order through Arrow batches; a task holds a batch and the
    state of one path, however long paths are.  Rows of equal order follow each
    other by their columns.
    """
    names, columns = list(keys), path.columns
    w = W.partitionBy(*keys).orderBy(order, *axes)
    total = F.lit(0.0)
    for a in axes:
        d = F.col(a) - F.lag(a).over(w)
        total = total + d * d
    walk = path.withColumn("walked_", F.sqrt(total)).withColumn("first_", F.col("walked_").isNull())
    rows = walk.repartition(*names).sortWithinPartitions(*names, order, *axes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walked = 0.0
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for i, (first, length) in enumerate(zip(batch.column("first_").to_pylist(), batch.column("walked_").to_pylist(), strict=True)):
                walked = 0.0 if first else walked + length
                if first or walked > step:
                    kept[i], walked = True, 0.0
            yield batch.select(columns).filter(pa.array(kept))

    return rows.mapInArrow(keep, path.schema)
