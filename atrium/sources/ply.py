"""PLY point clouds as a Spark data source.

``spark.read.format("ply").load(folder)`` plans byte ranges of every file's
vertex table, so that a large cloud is read by many tasks; ASCII files are one
partition each.  ``write_ply`` writes one binary file a cloud.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.spatial import crop
from .files import Folder

SCHEMA = "cloud_id string, point_id long, x double, y double, z double, r double, g double, b double, label long"
_KINDS = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8", "int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}
#: Vertices that one partition reads.
RANGE = 1 << 20


def _line(f) -> bytes:
    """A line of a file that may have no readline of its own."""
    if hasattr(f, "readline") and not hasattr(f, "read_at"):
        return f.readline()
    out = b""
    while not out.endswith(b"\n") and (c := f.read(1)):
        out += c
    return out


def read_header(f) -> tuple[str, int, list[tuple[str, str]], int]:
    """Format, number of vertices, their properties (name, numpy kind), and where the vertex table starts."""
    if _line(f).strip() != b"ply":
        raise ValueError("not a PLY file")
    form, n, fields, element = "", 0, [], ""
    while True:
        line = _line(f)
        words = line.decode("ascii").split()
        if not line or words[:1] == ["end_header"]:
            return form, n, fields, f.tell()
        if words[0] == "format":
            form = words[1]
        elif words[0] == "element":
            element, n = words[1], int(words[2]) if words[1] == "vertex" else n
        elif words[0] == "property" and element == "vertex":
            fields.append((words[2], _KINDS[words[1]]))


class PlyReader(DataSourceReader):
    def __init__(self, path: str):
        one = path.endswith(".ply")
        self.path, self.only = (os.path.dirname(path) or ".", os.path.basename(path)) if one else (path, None)

    def partitions(self):
        folder = Folder(self.path)
        out = []
        for name in [self.only] if self.only else [n for n in folder.names() if n.endswith(".ply")]:
            with folder.open(name, "rb") as f:
                form, n, _, _ = read_header(f)
            step = RANGE if form == "binary_little_endian" else max(n, 1)
            out += [InputPartition((name, a, min(n, a + step))) for a in range(0, n, step)]
        return out or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        name, first, last = partition.value
        with Folder(self.path).open(name, "rb") as f:
            form, _, fields, start = read_header(f)
            if form == "binary_little_endian":
                kind = np.dtype(fields)
                f.seek(start + first * kind.itemsize)
                rows = np.frombuffer(f.read((last - first) * kind.itemsize), kind)
            elif form == "ascii":
                table = np.array([_line(f).split() for _ in range(last)], float).reshape(last, len(fields))
                rows = {c: table[:, i] for i, (c, _) in enumerate(fields)}
            else:
                raise ValueError(f"PLY format {form} isn't read")
        names = {c for c, _ in fields}
        n = last - first
        real = lambda c, scale=1.0: pa.array(np.asarray(rows[c], float) / scale) if c in names else pa.nulls(n, pa.float64())
        label = next((c for c in ("label", "object_id", "class") if c in names), None)
        colours = [real(c, 255.0) for c in ("red", "green", "blue")]
        cloud = os.path.splitext(os.path.basename(name))[0]
        yield pa.RecordBatch.from_arrays([pa.array([cloud] * n), pa.array(np.arange(first, last)), real("x"), real("y"), real("z"), *colours, pa.array(np.asarray(rows[label]).astype(np.int64)) if label else pa.nulls(n, pa.int64())], ["cloud_id", "point_id", "x", "y", "z", "r", "g", "b", "label"])


class PlyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlyReader:
        return PlyReader(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(PlyDataSource)


def write_ply(points: DataFrame, folder: str, cloud: str = "cloud_id") -> DataFrame:
    """One binary file a cloud under a shared folder; returns cloud, path and number of points. An export: Parquet is the working format."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[cloud].iloc[0]
        to = Folder(folder)
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(pdf)}\nproperty double x\nproperty double y\nproperty double z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
        rows = np.zeros(len(pdf), [("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("r", "u1"), ("g", "u1"), ("b", "u1")])
        for c in "xyz":
            rows[c] = pdf[c]
        for c in "rgb":
            rows[c] = np.clip(np.nan_to_num(pdf[c].to_numpy(float)) * 255, 0, 255).round()
        # a lost or repeated task leaves no half of a file under the cloud's name
        part = f"{name}.{uuid.uuid4().hex}.part"
        with to.open(part, "wb") as f:
            f.write(head.encode() + rows.tobytes())
        to.rename(part, f"{name}.ply")
        return pd.DataFrame({"cloud_id": [str(name)], "path": [f"{folder}/{name}.ply"], "n_points": [len(pdf)]})

    return points.select(cloud, "x", "y", "z", "r", "g", "b").groupBy(cloud).applyInPandas(run, "cloud_id string, path string, n_points long")


def write_crop(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float], folder: str, cloud: str = "cloud_id") -> DataFrame:
    """write_ply of the points in a box."""
    return write_ply(crop(points, low, high), folder, cloud)
