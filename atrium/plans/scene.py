"""Building a scene's hierarchy from points, poses and floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geometry import rgb_hex
from ..functions.phrases import ASKED_ROOMS, UNASKED_OBJECTS, parent_id
from ..functions.vector import mean_vectors
from ..operators import graph, ordered, spatial, tiles
from ..operators.masks import match_colours
from ..session import cut


def find_floors(points: DataFrame, bin_width: float = 0.01, sigma: float = 2.0, min_bins: int = 20, keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """Floors of each scene: histogram of heights, Gaussian smoothing, peaks above the 90th percentile, pairing."""
    smooth = ordered.gaussian_smooth(ordered.dense(ordered.histogram(points, F.col("y"), bin_width, keys), keys), sigma, keys=keys)
    high = smooth.groupBy(*keys).agg(F.percentile("smooth", F.lit(0.9)).alias("high"))
    peaks = ordered.local_peaks(smooth.join(high, list(keys)), "smooth", F.col("high"), min_bins, keys)
    ends = points.groupBy(*keys).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return ordered.floor_intervals(peaks.select(*keys, ((F.col("bin") + 0.5) * bin_width).alias("height"), F.col("smooth").alias("n")), ends, keys=keys)


def objects_on_floors(boxes: DataFrame, floors: DataFrame, margin: float = 0.2, keys: tuple[str, ...] = ()) -> DataFrame:
    """Objects whose heights lie within a floor's and a margin; one that fits two floors is on both, one that fits none is dropped.

    keys: the scene's; without any, all floors are those of one building.
    """
    fits = (F.col("y0") > F.col("low") - margin) & (F.col("y1") < F.col("high") + margin)
    return boxes.join(floors, list(keys)).where(fits) if keys else boxes.join(floors, fits)


def _with_centres(rows: DataFrame, centres: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each row with the room centres of its scene; without keys all rooms are those of one building, a small table."""
    return rows.join(centres, list(keys)) if keys else rows.crossJoin(centres)


def assign_rooms(points: DataFrame, rooms: DataFrame, segment: str = "segment", radius: float = 0.2, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, segment and room_id: the room with the most cells near the object's points (in x and z), without any the nearest by centre.

    points: keys, segment, point_id, x, z; rooms: keys, room_id, cell_id, x, z (room cells).
    """
    names = list(keys)
    kind = points.schema[segment].dataType if points.schema[segment].dataType == rooms.schema["room_id"].dataType else "string"
    flat = ("x", "z")
    # an object's points at one place are one; only rooms' cells are counted
    seen = spatial.finite(points, flat).select(*names, F.lit(0).alias("side"), F.col(segment).cast(kind).alias("a"), *flat).distinct().withColumn("point", F.monotonically_increasing_id().cast(rooms.schema["cell_id"].dataType))
    cells = spatial.finite(rooms, flat).select(*names, F.lit(1).alias("side"), F.col("room_id").cast(kind).alias("a"), *flat, F.col("cell_id").alias("point"))
    near = tiles.near_numbers(cut(seen).unionByName(cells), radius, keys, flat, True).where("side = 1")
    share = near.select(*names, F.col("b").cast(points.schema[segment].dataType).alias(segment), F.col("a").cast(rooms.schema["room_id"].dataType).alias("room_id"), F.col("n").alias("hits"))
    size = points.groupBy(*names, segment).agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("z").alias("cz"))
    best = share.groupBy(*names, segment).agg(F.min_by("room_id", F.struct(-F.col("hits"), F.col("room_id"))).alias("by_overlap"))
    centres = rooms.groupBy(*names, "room_id").agg(F.avg("x").alias("rx"), F.avg("z").alias("rz"))
    dx, dz = F.col("cx") - F.col("rx"), F.col("cz") - F.col("rz")
    rest = _with_centres(size.join(best, [*names, segment], "left_anti"), centres, keys)
    fallback = rest.groupBy(*names, segment).agg(F.min_by("room_id", F.struct((dx * dx + dz * dz).alias("d2"), "room_id")).alias("by_centre"))
    return size.select(*names, segment).join(best, [*names, segment], "left").join(fallback, [*names, segment], "left").select(*names, segment, F.coalesce("by_overlap", "by_centre").alias("room_id"))


def assign_cameras(cameras: DataFrame, rooms: DataFrame, low: Column | float, high: Column | float, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, room_id and frame_id: each camera within the floor's heights to its nearest room; a room without one gets the nearest such camera."""
    names = list(keys)
    inside = cameras.where(F.col("y").between(low, high)).select(*names, "frame_id", F.col("x").alias("fx"), F.col("z").alias("fz"))
    centres = rooms.groupBy(*names, "room_id").agg(F.avg("x").alias("rx"), F.avg("z").alias("rz"))
    dx, dz = F.col("fx") - F.col("rx"), F.col("fz") - F.col("rz")
    scored = _with_centres(inside, centres, keys).withColumn("d2", dx * dx + dz * dz)
    first = scored.groupBy(*names, "frame_id").agg(F.min_by("room_id", F.struct("d2", "room_id")).alias("room_id"))
    rest = scored.join(first.select(*names, "room_id").distinct(), [*names, "room_id"], "left_anti")
    filled = rest.groupBy(*names, "room_id").agg(F.min_by("frame_id", F.struct("d2", "frame_id")).alias("frame_id"))
    return first.select(*names, "room_id", "frame_id").unionByName(filled.select(*names, "room_id", "frame_id"))


def fuse_features(hits: DataFrame, point: str = "map_point", frame: str = "frame_id", pixel: str = "pixel_id", vector: str = "embedding", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, point, mean_vector, frames: the mean over frames of the feature of a map point's last pixel in each; of equal pixels the largest feature."""
    once = hits.groupBy(*keys, point, frame).agg(F.max(F.struct(pixel, vector)).alias("last")).select(*keys, point, frame, F.col(f"last.{vector}").alias(vector))
    return mean_vectors(once, [*keys, point], vector, extra=(F.count("*").alias("frames"),))


def fuse_pixels(pixels: DataFrame, cloud: DataFrame, cell: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, point_id, mean_vector, frames: pixels (keys, pixel_id, frame_id, x, y, z, embedding) snapped to their nearest map point and fused."""
    at = spatial.nearest(pixels.select(*keys, "pixel_id", *spatial.AXES), cloud.select(*keys, "point_id", *spatial.AXES), "pixel_id", "point_id", cell, keys)
    return fuse_features(pixels.join(at.select(*keys, "pixel_id", "point_id"), [*keys, "pixel_id"]), "point_id", keys=keys)


def gather_mask_features(masks: DataFrame, cloud: DataFrame, features: DataFrame, cell: float, segment: str = "segment", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, segment, point_id, embedding: for each point of a mask the feature of its nearest map point; points of no feature drop out.

    masks: keys, segment, mask_point, x, y, z; cloud: keys, point_id, x, y, z; features: keys, point_id, embedding.
    """
    at = spatial.nearest(masks.select(*keys, "mask_point", *spatial.AXES), cloud.select(*keys, "point_id", *spatial.AXES), "mask_point", "point_id", cell, keys)
    named = masks.select(*keys, segment, "mask_point").join(at, [*keys, "mask_point"]).join(features, [*keys, "point_id"])
    return named.select(*keys, segment, "mask_point", "point_id", "embedding")


def room_points(cells: DataFrame, cloud: DataFrame, low: Column, high: Column, step: float, radius: float) -> DataFrame:
    """room_id, point_id: a floor's points that are near a room's cells, raised level by level from ``low`` to ``high``.

    cells: room_id, x, z; cloud: point_id, x, y, z.
    """
    raised = spatial.extrude(cells, low, high, step).select("room_id", *spatial.AXES)
    near = spatial.within_radius(raised, cloud.select("point_id", *spatial.AXES), radius, strict=False)
    return near.select(F.col("l.room_id").alias("room_id"), F.col("r.point_id").alias("point_id")).distinct()


def region_stats(points: DataFrame, keys: tuple[str, ...] = ("scene", "region_id")) -> DataFrame:
    """keys, min_height, max_height, mean_height, n_points of each region's points."""
    return points.groupBy(*keys).agg(F.min("y").alias("min_height"), F.max("y").alias("max_height"), F.avg("y").alias("mean_height"), F.count("*").alias("n_points"))


def floor_bounds(regions: DataFrame, keys: tuple[str, ...] = ("scene", "floor_id")) -> DataFrame:
    """keys, lower, upper: a floor's bounds as the means of its regions' least and largest heights."""
    return regions.groupBy(*keys).agg(F.avg("min_height").alias("lower"), F.avg("max_height").alias("upper"))


def panoptic_truth(points: DataFrame, objects: DataFrame, floors: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The true objects, regions and floors of scenes whose clouds are coloured by object.

    points: scene, region_id, x, y, z, r, g, b in [0, 1]; objects: scene,
    object_id, category, r, g, b; floors: scene, floor_id, low, high; labels:
    scene, region_id, category.  Points belong to the object of their colour;
    a region is on the floor that holds its mean height; objects take the
    region with most of their points (ties the least).  A region without a
    label has a null category.
    """
    hits = match_colours(points, objects.drop("category"), ("scene",))
    where = hits.groupBy("scene", "object_id", "region_id").agg(F.count("*").alias("n"))
    home = where.groupBy("scene", "object_id").agg(F.min_by("region_id", F.struct(-F.col("n"), F.col("region_id"))).alias("region_id"))
    boxes = spatial.bounds(hits, ("scene", "object_id")).join(home, ["scene", "object_id"]).join(objects.select("scene", "object_id", "category", colour_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex")), ["scene", "object_id"])
    stats = region_stats(points).join(labels.select("scene", "region_id", "category"), ["scene", "region_id"], "left")
    held = (F.col("mean_height") > F.col("low")) & (F.col("mean_height") < F.col("high"))
    regions = stats.join(floors.select("scene", "floor_id", "low", "high"), ["scene"]).where(held).drop("low", "high")
    levels = floor_bounds(regions)
    placed = boxes.join(regions.select("scene", "region_id", "floor_id"), ["scene", "region_id"], "left")
    return placed, regions, levels


def colour_hex(r: Column, g: Column, b: Column) -> Column:
    """Channels in [0, 1] as six hexadecimal digits."""
    return rgb_hex(*[F.round(c * 255) for c in (r, g, b)])


def objects_by(truth: DataFrame, wanted: DataFrame, by: str = "object_id") -> DataFrame:
    """The true objects of wanted keys (scene and object_id, hex or region_id): a lookup as a join."""
    return truth.join(wanted.select("scene", by).distinct(), ["scene", by], "left_semi")


def asked_tree(regions: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the rooms and objects that long queries ask for, linked by the prefixes of their ids.

    regions: room_id "f_r" and category; objects: object_id "f_r_o" and
    category.  Rooms of other categories, their objects, and objects of
    structure are left out; floors and the building stand above.
    """
    rooms = regions.where(F.col("category").isin(*ASKED_ROOMS)).select("room_id", F.col("category").alias("name"), parent_id(F.col("room_id")).alias("floor_id"))
    things = objects.where(~F.col("category").isin(*UNASKED_OBJECTS)).select("object_id", F.col("category").alias("name"), parent_id(F.col("object_id")).alias("room_id"))
    kept = things.join(rooms.select("room_id"), "room_id", "left_semi")
    floors = regions.select(parent_id(F.col("room_id")).alias("floor_id")).distinct().withColumn("name", F.col("floor_id"))
    return graph.assemble(floors, rooms, kept)


def hierarchy_ids(objects: DataFrame) -> DataFrame:
    """object_id "f_r_o": numbers in order of id within the room."""
    w = W.partitionBy("floor_id", "room_id").orderBy("object_no")
    return objects.withColumn("object_id", F.concat_ws("_", "floor_id", "room_id", (F.row_number().over(w) - 1).cast("string")))
