"""Posed RGB-D frames and their pixels, joined on frame number rather than on position in a listing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Folder layouts: colour, depth and pose folders, and the depth scale, None where the camera file has it.
LAYOUTS = {"walks": ("rgb", "depth", "pose", 1000.0), "scans": ("color", "depth", "pose", 1000.0), "results": ("results", "results", None, None)}


def frame_number(path: Column) -> Column:
    """The last number in a file's name, so that frame 10 follows frame 9."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d+)\D*$", 1).cast("int")


def read_poses(spark: SparkSession, folder: str, flip: bool = False) -> DataFrame:
    """frame_id, pose (16 numbers, row-major) of one pose file a frame, on one line or on four."""
    texts = spark.read.text(folder, wholetext=True).select(frame_number(F.input_file_name()).alias("frame_id"), G.pose_values(F.col("value")).alias("pose"))
    return texts.withColumn("pose", G.flip_yz(F.col("pose"))) if flip else texts


def read_trajectory(spark: SparkSession, file: str) -> DataFrame:
    """frame_id (line number from 0), pose of a file with one pose a line; lines are numbered as they stand in the file."""
    lines = spark.read.text(file, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("frame_id", "line"))
    return lines.select("frame_id", G.pose_values(F.col("line")).alias("pose"))


def read_matrix_intrinsics(spark: SparkSession, file: str) -> DataFrame:
    """fx, fy, cx, cy of a text file with a camera matrix of three or four columns, a row a line."""
    values = spark.read.text(file, wholetext=True).select(F.split(F.trim(F.element_at(F.split(F.trim("value"), r"[ \t]*\r?\n"), 1)), r"\s+").alias("head"), G.pose_values(F.col("value")).alias("k"))
    width = F.size("head")
    at = lambda row, col: F.element_at("k", (width * row + col + 1).cast("int"))
    return values.select(at(0, 0).alias("fx"), at(1, 1).alias("fy"), at(0, 2).alias("cx"), at(1, 2).alias("cy"))


def read_camera_file(spark: SparkSession, file: str) -> DataFrame:
    """w, h, fx, fy, cx, cy, depth_scale of a JSON document {"camera": {..., "scale": ...}}."""
    schema = "camera struct<w: int, h: int, fx: double, fy: double, cx: double, cy: double, scale: double>"
    return spark.read.schema(schema).json(file, multiLine=True).select("camera.w", "camera.h", "camera.fx", "camera.fy", "camera.cx", "camera.cy", F.col("camera.scale").alias("depth_scale"))


def read_pose_list(spark: SparkSession, file: str) -> DataFrame:
    """frame_id (line number from 0), x, y, z and quaternion (w, x, y, z) of a tab-separated file of flattened 4 x 4 poses."""
    poses = read_trajectory(spark, file)
    x, y, z = G.position(F.col("pose"))
    return poses.select("frame_id", x.alias("x"), y.alias("y"), z.alias("z"), G.quaternion(F.col("pose")).alias("quaternion"))


def decode_depth(frames: DataFrame, column: str = "depth") -> DataFrame:
    """frame_id, row, col, depth_raw of every pixel of 16-bit greyscale PNG files (not interlaced) in a binary column.

    A frame that isn't such a file raises; each is decoded in one Arrow batch row
    and yields its pixels in blocks of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, data in zip(batch.column("frame_id").to_pylist(), batch.column(column).to_pylist(), strict=True):
                image = grey16(data)
                height, width = image.shape
                step = max(1, (1 << 18) // max(1, width))
                for a in range(0, height, step):
                    part = image[a : a + step]
                    row, col = np.indices(part.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.size, frame, np.int32)), pa.array((row.ravel() + a).astype(np.int32)), pa.array(col.ravel().astype(np.int32)), pa.array(part.ravel().astype(np.int32))], ["frame_id", "row", "col", "depth_raw"])

    return frames.select(F.col("frame_id").cast("int").alias("frame_id"), column).mapInArrow(run, "frame_id int, row int, col int, depth_raw int")


def grey16(data: bytes) -> np.ndarray:
    """The samples of a 16-bit greyscale PNG file."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head = 8, [], b""
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        head = body if kind == b"IHDR" else head
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    if head[8:10] != b"\x10\x00" or head[12]:
        raise ValueError("only 16-bit greyscale PNG files that aren't interlaced are read")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + 2 * width)
    out = np.zeros((height + 1, 2 * width + 2), np.int64)  # a row and two bytes of zeros before the first ones
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:].astype(np.int64)
        above = out[y]
        if kind in (0, 2):
            out[y + 1, 2:] = (line + (above[2:] if kind == 2 else 0)) & 255
        elif kind == 1:
            out[y + 1, 2:] = np.cumsum(line.reshape(-1, 2), axis=0).ravel() & 255
        else:
            now = out[y + 1]
            for i in range(2, len(now)):
                a, b, c = now[i - 2], above[i], above[i - 2]
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] if kind == 4 else (a + b) // 2
                now[i] = (line[i - 2] + near) & 255
    return (out[1:, 2::2] << 8) | out[1:, 3::2]


def read_frames(spark: SparkSession, root: str, layout: str, flip: bool = False, every: int = 1) -> DataFrame:
    """frame_id, rgb, depth (file contents), pose, depth_scale of every ``every``-th frame that has all parts."""
    colour, depth, pose, scale = LAYOUTS[layout]
    files = lambda sub, name: spark.read.format("binaryFile").load(f"{root}/{sub}").select(frame_number(F.col("path")).alias("frame_id"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").alias(name))
    rgb, deep = files(colour, "rgb"), files(depth, "depth")
    if colour == depth:
        rgb, deep = rgb.where(F.col("file").startswith("frame")), deep.where(F.col("file").startswith("depth"))
    poses = read_poses(spark, f"{root}/{pose}", flip) if pose else read_trajectory(spark, f"{root}/traj.txt")
    wanted = lambda df: df.where(F.col("frame_id") % every == 0)
    frames = wanted(rgb.drop("file")).join(wanted(deep.drop("file")), "frame_id").join(wanted(poses), "frame_id")
    if scale is not None:
        return frames.withColumn("depth_scale", F.lit(scale))
    return frames.join(read_camera_file(spark, f"{root}/cam_params.json").select("depth_scale"))


def pixels_to_points(pixels: DataFrame, cameras: DataFrame) -> DataFrame:
    """World points of pixels with a depth: pixels frame_id, row, col, depth_raw; cameras frame_id, pose, fx, fy, cx, cy, depth_scale."""
    joined = pixels.where("depth_raw > 0").join(cameras, "frame_id")
    x, y, z = G.back_project(F.col("col"), F.col("row"), F.col("depth_raw") / F.col("depth_scale"), *map(F.col, ("fx", "fy", "cx", "cy")))
    wx, wy, wz = G.transform(F.col("pose"), x, y, z)
    extra = [c for c in pixels.columns if c not in ("depth_raw",)]
    return joined.select(*extra, wx.alias("x"), wy.alias("y"), wz.alias("z"))
