"""Geometry expressions: cameras, rigid transforms, grids, boxes and colour ids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pose_values(text: Column) -> Column:
    """The 16 numbers of a pose text (one line or four), row-major."""
    return F.transform(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"[\s,]+"), lambda x: x.cast("double"))


def flip_yz(pose: Column) -> Column:
    """Pose times diag(1, -1, -1, 1): columns 1 and 2 change sign."""
    return F.transform(pose, lambda x, i: F.when((i % 4 == 1) | (i % 4 == 2), -x).otherwise(x))


def swap_flip(x: Column, y: Column, z: Column, swap: bool = True) -> tuple[Column, Column, Column]:
    """A cloud's axes turned: y and z change places (if ``swap``), then z changes its sign."""
    return (x, z, -y) if swap else (x, y, -z)


def position(pose: Column) -> tuple[Column, Column, Column]:
    """The translation of a row-major pose."""
    return pose[3], pose[7], pose[11]


def quaternion(pose: Column) -> Column:
    """w, x, y, z of a rotation with a positive trace or its largest diagonal element leading."""
    m = lambda r, c: pose[4 * r + c]
    t = m(0, 0) + m(1, 1) + m(2, 2)
    s0 = 2 * F.sqrt(1 + t)
    s1 = 2 * F.sqrt(1 + m(0, 0) - m(1, 1) - m(2, 2))
    s2 = 2 * F.sqrt(1 + m(1, 1) - m(0, 0) - m(2, 2))
    s3 = 2 * F.sqrt(1 + m(2, 2) - m(0, 0) - m(1, 1))
    return (
        F.when(t > 0, F.array(s0 / 4, (m(2, 1) - m(1, 2)) / s0, (m(0, 2) - m(2, 0)) / s0, (m(1, 0) - m(0, 1)) / s0))
        .when((m(0, 0) > m(1, 1)) & (m(0, 0) > m(2, 2)), F.array((m(2, 1) - m(1, 2)) / s1, s1 / 4, (m(0, 1) + m(1, 0)) / s1, (m(0, 2) + m(2, 0)) / s1))
        .when(m(1, 1) > m(2, 2), F.array((m(0, 2) - m(2, 0)) / s2, (m(0, 1) + m(1, 0)) / s2, s2 / 4, (m(1, 2) + m(2, 1)) / s2))
        .otherwise(F.array((m(1, 0) - m(0, 1)) / s3, (m(0, 2) + m(2, 0)) / s3, (m(1, 2) + m(2, 1)) / s3, s3 / 4))
    )


def intrinsics(width: Column, height: Column, hfov: float = 90.0) -> tuple[Column, Column, Column, Column]:
    """fx, fy, cx, cy of a pinhole camera with the given horizontal field of view in degrees."""
    h = math.radians(hfov)
    vfov = 2 * F.atan(F.lit(math.tan(h / 2)) * height / width)
    return width / (2 * math.tan(h / 2)), height / (2 * F.tan(vfov / 2)), width / 2, height / 2


def back_project(col: Column, row: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    """Camera coordinates of a pixel; rows with depth <= 0 are to be filtered by the caller."""
    return (col - cx) * depth / fx, (row - cy) * depth / fy, depth


def transform(pose: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A row-major 4x4 pose applied to a point."""
    return tuple(pose[4 * r] * x + pose[4 * r + 1] * y + pose[4 * r + 2] * z + pose[4 * r + 3] for r in range(3))


def voxel(x: Column, size: float, origin: Column | float = 0.0) -> Column:
    return F.floor((x - origin) / size).cast("long")


def world_to_grid(p: Column, low: Column, cell: float) -> Column:
    """Truncates towards zero, as an integer cast does."""
    return ((p - low) / cell).cast("int")


def grid_to_world(cell_index: Column, low: Column, cell: float, shift: float = 0.0) -> Column:
    """World coordinate of a cell; shift undoes padding, as in (cell - 10.5) * size + low."""
    return (cell_index - shift) * cell + low


def box_corners(cx: Column, cy: Column, cz: Column, dx: Column, dy: Column, dz: Column) -> Column:
    """The 8 corners of an axis-aligned box as an array of (x, y, z) structs."""
    return F.array(*[F.struct((cx + i * dx / 2).alias("x"), (cy + j * dy / 2).alias("y"), (cz + k * dz / 2).alias("z")) for i in (-1, 1) for j in (-1, 1) for k in (-1, 1)])


def box_centre(box: Column) -> tuple[tuple[Column, Column, Column], tuple[Column, Column, Column]]:
    """Centre and dimensions of a box struct with x0, x1, y0, ..."""
    ends = [(box[f"{a}0"], box[f"{a}1"]) for a in "xyz"]
    return tuple((a + b) / 2 for a, b in ends), tuple(b - a for a, b in ends)


def box_iou(a: str, b: str) -> Column:
    """IoU of boxes in struct columns a and b with x0, y0, z0, x1, y1, z1; 0 where the union is 0."""
    side = lambda axis: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{axis}1"), F.col(f"{b}.{axis}1")) - F.greatest(F.col(f"{a}.{axis}0"), F.col(f"{b}.{axis}0")))
    volume = lambda box: (F.col(f"{box}.x1") - F.col(f"{box}.x0")) * (F.col(f"{box}.y1") - F.col(f"{box}.y0")) * (F.col(f"{box}.z1") - F.col(f"{box}.z0"))
    inter = side("x") * side("y") * side("z")
    union = volume(a) + volume(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def grow_bbox(x: Column, y: Column, w: Column, h: Column, margin: float) -> tuple[Column, ...]:
    """XYWH grown by a margin, clamped at 0 on the low side only."""
    x0, y0 = F.greatest(F.lit(0), x - margin), F.greatest(F.lit(0), y - margin)
    return x0, y0, x + w + margin - x0, y + h + margin - y0


def rgb_to_id(r: Column, g: Column, b: Column) -> Column:
    return r + 256 * g + 65536 * b


def id_to_rgb(i: Column) -> tuple[Column, Column, Column]:
    return i % 256, F.floor(i / 256).cast("long") % 256, F.floor(i / 65536).cast("long") % 256


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(*[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)])
