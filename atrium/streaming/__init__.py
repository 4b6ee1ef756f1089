"""Incremental forms of map building: micro-batches merged into voxel maps, and windows over pose streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geometry import voxel


def voxel_stream(points: DataFrame, size: float) -> DataFrame:
    """Running voxel sums of a point stream: state is one row a voxel; means are sums over n."""
    cells = [voxel(F.col(a), size).alias(f"v{a}") for a in "xyz"]
    return points.groupBy(*cells).agg(*[F.sum(a).alias(f"sum_{a}") for a in "xyz"], F.count("*").alias("n"))


def pose_windows(poses: DataFrame, length: str = "5 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Heights of poses in tumbling windows of event time, closed by a watermark."""
    return poses.withWatermark("ts", late).groupBy(F.window("ts", length), key).agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count("*").alias("n"))


def pose_sessions(poses: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Walks: poses of a key without a gap in event time."""
    return poses.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"), F.max("y").alias("high"))


def merge_into(stream: DataFrame, path: str, size: float, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's voxel sums under its batch id; compacted() reads the map.

    A batch that runs again after a failure overwrites its own part, so points count once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        voxel_stream(batch, size).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compacted(spark, path: str) -> DataFrame:
    """vx, vy, vz, x, y, z, n over all batches so far."""
    sums = spark.read.parquet(path).groupBy("vx", "vy", "vz").agg(*[F.sum(f"sum_{a}").alias(a) for a in "xyz"], F.sum("n").alias("n"))
    return sums.select("vx", "vy", "vz", *[(F.col(a) / F.col("n")).alias(a) for a in "xyz"], "n")
