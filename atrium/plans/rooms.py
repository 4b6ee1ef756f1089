"""Rooms of scenes from their points: walls and outline of each floor, seeds far from walls, floods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import raster
from ..operators.spatial import finite
from ..session import cut
from .scene import find_floors

#: Fixed values of the behaviour that is matched: kernels (rows and columns to each side, sigma) of walls, outline and depth, the walls' share of the
#: highest count, and the cells around a floor's box that count as walls.
WALL_BLUR, OUTLINE_BLUR, DEPTH_BLUR = ((2, 2), 1.0), ((10, 10), 2.0), ((5, 0), 10.0)
WALL_SHARE, BORDER = 0.25, 10
OUTLINE_GAP, FREE_WIDTH = 6, 2


def _beside(cells: DataFrame, of_key: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """cells with their key's row of another table; without keys that table is one row."""
    return cells.join(of_key, list(keys)) if keys else cells.crossJoin(of_key)


def _grey(cells: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Values as whole numbers from 0 to 255, the largest of each key being 255."""
    scaled = _beside(cells, cells.groupBy(*keys).agg(F.max(value).alias("most")), keys)
    return scaled.select(*keys, "row", "col", F.floor(255.0 * F.col(value) / F.col("most")).cast("double").alias("grey"))


def _blurred(cells: DataFrame, kernel: tuple[tuple[int, int], float], keys: tuple[str, ...]) -> DataFrame:
    radii, sigma = kernel
    # sums in any order agree to far more than six digits
    return raster.gaussian_blur(cells, radii, sigma, "grey", keys).withColumn("grey", F.round(F.round("grey", 6)))


def wall_cells(points: DataFrame, cell: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells that hold many points seen from above: blurred counts above a quarter of the highest, gaps of one cell closed."""
    blurred = cut(_blurred(_grey(raster.occupied(points, cell, keys), "n", keys), WALL_BLUR, keys))
    most = blurred.groupBy(*keys).agg(F.max("grey").alias("most"))
    return raster.close(_beside(blurred, most, keys).where(F.col("grey") > WALL_SHARE * F.col("most")).select(*keys, "row", "col"), 1, keys, disc=True)


def outline_cells(points: DataFrame, cell: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """A floor's ground: cells near any point, gaps closed and everything enclosed filled."""
    near = _blurred(_grey(raster.occupied(points, cell, keys), "n", keys), OUTLINE_BLUR, keys).where("grey > 0").select(*keys, "row", "col")
    return raster.fill_holes(raster.close(cut(near), OUTLINE_GAP, keys), keys)


def seed_cells(free: DataFrame, image: DataFrame, least_area: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, row, col, seed: parts of the free cells that lie far from walls, named by their least cell.

    Distances to the nearest wall are scaled to 255, blurred along rows, and cut
    at Otsu's threshold over the whole image (keys and size: its number of
    cells), where cells that aren't free count 0.  Parts are filled; those whose
    outline through cell centres holds no more than ``least_area`` cells drop out.
    """
    depth = raster.nearest_wall(free, keys).select(*keys, "row", "col", F.sqrt("d2").alias("depth"))
    blurred = cut(_blurred(_grey(depth, "depth", keys), DEPTH_BLUR, keys))
    bins = blurred.where("grey > 0").groupBy(*keys, F.col("grey").cast("long").alias("bin")).agg(F.count("*").alias("n"))
    seen = bins.groupBy(*keys).agg(F.sum("n").alias("n"))
    bins = bins.unionByName(_beside(image, seen, keys).select(*keys, F.lit(0).cast("long").alias("bin"), (F.col("size") - F.col("n")).alias("n")))
    threshold = raster.otsu(bins, keys)
    far = _beside(blurred, threshold, keys).where("grey > threshold").select(*keys, "row", "col")
    parts = cut(raster.cell_components(raster.fill_holes(far, keys), keys))
    inner = raster.erode(parts, 1, (*keys, "component"), disc=True).withColumn("inner", F.lit(1))
    # a polygon through lattice points holds all of them but half of those on its line, and one
    sized = parts.join(inner, [*keys, "component", "row", "col"], "left").groupBy("component").agg(F.count("*").alias("n"), F.count("inner").alias("inside"))
    large = sized.where(F.col("n") - (F.col("n") - F.col("inside")) / 2 - 1 > least_area).select("component")
    return parts.join(large, "component", "left_semi").select(*keys, "row", "col", F.col("component").alias("seed")).join(free, [*keys, "row", "col"], "left_semi")


def rooms_on_floors(points: DataFrame, floors: DataFrame, cell: float = 0.05, above: float = 1.5, below: float = 0.3, below_outline: float = 0.2, least_side: float = 0.5, keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """keys, floor_id, room_id, row, col, x, z: the free cells of each room, with their centres.

    points: keys, x, y, z (y is up); floors: keys, floor_id, low, high.  Walls
    are seen between ``above`` the floor and ``below`` the ceiling, the outline
    under ``below_outline``.  Free is what lies inside the outline, off walls,
    and holds a square of five cells; seeds of more than ``least_side`` squared
    flood it side by side.  Rooms are numbered from 0 in the order of their
    seeds' least row and column, as floor_id, "_", number.  Points without
    finite coordinates are left out; a floor without walls, free cells or seeds
    has no rooms, and free cells that no flood reaches are in none.
    """
    by = (*keys, "floor_id")
    named = floors.select(*keys, "floor_id", "low", "high")
    on = finite(points).select(*keys, "x", "y", "z")
    on = cut((on.join(named, list(keys)) if keys else on.crossJoin(named)).where((F.col("y") >= F.col("low")) & (F.col("y") < F.col("high"))))
    walls = wall_cells(on.where((F.col("y") >= F.col("low") + above) & (F.col("y") < F.col("high") - below)), cell, by)
    ground = on.where(F.col("y") < F.col("high") - below_outline)
    free = cut(raster.open_up(raster.subtract(outline_cells(ground, cell, by), walls, by), FREE_WIDTH, by))
    length = lambda c: F.max(F.floor(F.col(c) / cell)) - F.min(F.floor(F.col(c) / cell)) + 1 + 2 * BORDER
    image = ground.groupBy(*by).agg((length("x") * length("z")).alias("size"))
    seeds = cut(seed_cells(free, image, (least_side / cell) ** 2, by))
    first = seeds.groupBy(*by, "seed").agg(F.min(F.struct("row", "col")).alias("at"))
    number = F.row_number().over(W.partitionBy(*by).orderBy("at")) - 1
    numbered = first.select(*by, "seed", number.alias("room"))
    flooded = raster.flood(free, seeds.join(numbered, [*by, "seed"]).select(*by, "row", "col", "room"), by)
    centre = lambda c: (F.col(c) + 0.5) * cell
    return flooded.select(*by, F.concat_ws("_", F.col("floor_id").cast("string"), F.col("room").cast("string")).alias("room_id"), "row", "col", centre("row").alias("x"), centre("col").alias("z"))


def find_rooms(points: DataFrame, cell: float = 0.05, keys: tuple[str, ...] = ("scene",), **options: float) -> DataFrame:
    """Rooms of scenes whose floors aren't known: find_floors() first, then rooms_on_floors() with its options."""
    floors = find_floors(finite(points), keys=keys)
    return rooms_on_floors(points, cut(floors.withColumnRenamed("floor", "floor_id")), cell, keys=keys, **options)
