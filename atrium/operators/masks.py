"""2-D masks in long form: a row for each pixel (frame, mask, row, col) that a mask covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import as_doubles, normalize
from ..session import cut


def pixel_features(pixels: DataFrame, features: DataFrame, mask: str = "mask_id", keys: tuple[str, ...] = ("frame_id",), vector: str = "embedding", of: tuple[str, ...] | None = None) -> DataFrame:
    """keys, row, col, embedding: the normalised sum of the features of all masks that cover a pixel.

    of: those of the keys that features have, by default all; without any, a
    mask has one feature in all frames.  Pixels that the same masks cover have
    one sum, so vectors are summed once for each such set of masks, by element, and no pixel
    gathers its masks' vectors.
    """
    of = keys if of is None else of
    covered = cut(pixels.groupBy(*keys, "row", "col").agg(F.sort_array(F.collect_list(mask)).alias("masks")))
    sets = covered.select(*of, "masks").distinct()
    parts = sets.select(*of, "masks", F.explode("masks").alias(mask)).join(features.select(*of, mask, F.posexplode(as_doubles(vector)).alias("pos", "v")), [*of, mask])
    sums = parts.groupBy(*of, "masks", "pos").agg(F.sum("v").alias("v"))
    whole = sums.groupBy(*of, "masks").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("total"))
    return covered.join(cut(whole.select(*of, "masks", normalize(F.col("total")).alias(vector))), [*of, "masks"]).select(*keys, "row", "col", vector)


def containment(pixels: DataFrame, mask: str = "mask_id", keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """keys, outer, inner: masks that cover every pixel of another one; of equal masks the smaller id is the outer one."""
    size = pixels.groupBy(*keys, mask).agg(F.count("*").alias("size"))
    by_pixel = [*keys, "row", "col"]
    both = pixels.select(*by_pixel, F.col(mask).alias("outer")).join(pixels.select(*by_pixel, F.col(mask).alias("inner")), by_pixel).where(F.col("outer") != F.col("inner"))
    shared = both.groupBy(*keys, "outer", "inner").agg(F.count("*").alias("shared"))
    sized = shared.join(size.select(*keys, F.col(mask).alias("inner"), "size"), [*keys, "inner"]).join(size.select(*keys, F.col(mask).alias("outer"), F.col("size").alias("outer_size")), [*keys, "outer"])
    return sized.where((F.col("shared") == F.col("size")) & ((F.col("outer_size") > F.col("size")) | (F.col("outer") < F.col("inner")))).select(*keys, "outer", "inner")


def without_contained(pixels: DataFrame, mask: str = "mask_id", keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """The pixels of each mask that none of the masks inside it covers; a mask without pixels left has no rows.

    Containment is judged on the input, so the result doesn't depend on the order of masks.
    """
    inside = containment(pixels, mask, keys)
    taken = inside.join(pixels.select(*keys, F.col(mask).alias("inner"), "row", "col"), [*keys, "inner"]).select(*keys, F.col("outer").alias(mask), "row", "col").distinct()
    return pixels.join(taken, [*keys, mask, "row", "col"], "left_anti")


def bounding_boxes(pixels: DataFrame, mask: str = "mask_id", keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """keys, mask, x, y, w, h, area: each mask's box, bounds included in w and h."""
    x0, y0 = F.min("col"), F.min("row")
    return pixels.groupBy(*keys, mask).agg(x0.alias("x"), y0.alias("y"), (F.max("col") - x0 + 1).alias("w"), (F.max("row") - y0 + 1).alias("h"), F.count("*").alias("area"))


def crop_pixels(image: DataFrame, boxes: DataFrame, mask: str = "mask_id", keys: tuple[str, ...] = ("frame_id",), covered: DataFrame | None = None) -> DataFrame:
    """The image's pixels inside each box (x, y, w, h), in the box's own rows and columns; with ``covered``, those of the mask alone.

    image: keys, row, col and values.  A frame's pixels meet a frame's boxes.
    """
    inside = (F.col("row") >= F.col("y")) & (F.col("row") < F.col("y") + F.col("h")) & (F.col("col") >= F.col("x")) & (F.col("col") < F.col("x") + F.col("w"))
    rest = [c for c in image.columns if c not in (*keys, "row", "col")]
    cut = image.join(boxes.select(*keys, mask, "x", "y", "w", "h"), list(keys)).where(inside)
    if covered is not None:
        cut = cut.join(covered.select(*keys, mask, "row", "col"), [*keys, mask, "row", "col"], "left_semi")
    return cut.select(*keys, mask, (F.col("row") - F.col("y")).alias("row"), (F.col("col") - F.col("x")).alias("col"), *rest)


def resize_area(crops: DataFrame, boxes: DataFrame, to: int, values: tuple[str, ...], mask: str = "mask_id", keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Crops of any size as squares of ``to`` cells a side: each cell has the mean of the pixels that it covers, weighted by area.

    crops: keys, mask, row, col (from 0 in the box) and values; boxes: keys,
    mask, w, h.  A pixel that isn't there, as off a masked crop's mask, counts
    0 (black), as a null value does; cells that no pixel meets have no row.
    Sides are compared as whole numbers (pixel r spans r * to up to
    (r + 1) * to, cell k spans k * h up to (k + 1) * h), so weights are exact.
    """
    at = [*keys, mask]
    met = crops.join(boxes.select(*at, "w", "h"), at)
    for axis, side in (("row", "h"), ("col", "w")):
        last = F.floor(((F.col(axis) + 1) * to - 1) / F.col(side))
        met = met.withColumn(f"{axis}_to", F.explode(F.sequence(F.floor(F.col(axis) * to / F.col(side)), last)))
        overlap = F.least((F.col(axis) + 1) * to, (F.col(f"{axis}_to") + 1) * F.col(side)) - F.greatest(F.col(axis) * to, F.col(f"{axis}_to") * F.col(side))
        met = met.withColumn(f"{axis}_part", overlap)
    weight = F.col("row_part") * F.col("col_part")
    sums = [(F.sum(weight * F.coalesce(F.col(v), F.lit(0))) / F.first(F.col("h") * F.col("w"))).alias(v) for v in values]
    return met.groupBy(*at, F.col("row_to").alias("row"), F.col("col_to").alias("col")).agg(*sums)


def resize_nearest(rows: Column, length: Column, to: int) -> Column:
    """The row (column) of an image of so many rows after a resize: nearest neighbour, from each source cell's start."""
    return F.floor(rows * F.lit(to) / length).cast("long")


def colour_key(r: Column, g: Column, b: Column) -> Column:
    """Colours in [0, 1] as one number of rounded channels: near colours meet by equality."""
    channel = lambda c: F.round(c * 255).cast("long")
    return channel(r) + 256 * channel(g) + 65536 * channel(b)


def match_colours(points: DataFrame, objects: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """points (r, g, b in [0, 1]) with the object_id of the object of the same colour; points of no object drop out."""
    key = colour_key(F.col("r"), F.col("g"), F.col("b"))
    named = objects.select(*keys, "object_id", key.alias("colour"))
    return points.withColumn("colour", key).join(named, [*keys, "colour"]).drop("colour")


def colourise(ids: DataFrame, palette: DataFrame, column: str = "id") -> DataFrame:
    """ids with r, g, b of a palette (id, r, g, b); an unknown id is black."""
    named = palette.select(F.col("id").alias(column), "r", "g", "b")
    return ids.join(named, column, "left").fillna(0, ["r", "g", "b"])
