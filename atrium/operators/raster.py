"""Operators on sparse rasters: tables of cells (keys, row, col)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut
from .graph import components
from .spatial import nearest


def occupied(points: DataFrame, cell: float, keys: tuple[str, ...] = (), axes: tuple[str, str] = ("x", "z")) -> DataFrame:
    """The cells that hold a point, with their number of points and largest height."""
    row, col = (F.floor(F.col(a) / cell).cast("long") for a in axes)
    return points.groupBy(*keys, row.alias("row"), col.alias("col")).agg(F.count("*").alias("n"), F.max("y").alias("height"))


def top_colours(points: DataFrame, cell: float, keys: tuple[str, ...], point: str, colour: tuple[str, ...], axes: tuple[str, str] = ("x", "z")) -> DataFrame:
    """The colour of each cell's highest point; of equal heights the first point's."""
    row, col = (F.floor(F.col(a) / cell).cast("long") for a in axes)
    best = F.max_by(F.struct(*colour), F.struct(F.col("y"), -F.col(point)))
    return points.groupBy(*keys, row.alias("row"), col.alias("col")).agg(best.alias("top")).select(*keys, "row", "col", *[F.col(f"top.{c}").alias(c) for c in colour])


def _offsets(radius: int, disc: bool) -> Column:
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if not disc or i * i + j * j <= radius * radius]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])


def _spread(cells: DataFrame, radius: int, keys: tuple[str, ...], disc: bool, *rest: str) -> DataFrame:
    out = cells.select(*keys, "row", "col", *rest, F.explode(_offsets(radius, disc)).alias("o"))
    return out.select(*keys, (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), *rest)


def _along(cells: DataFrame, radius: int, axis: str, *rest: str) -> DataFrame:
    """Each cell at all places up to ``radius`` along one axis, with ``rest`` and the step."""
    others = [c for c in ("row", "col") if c != axis]
    out = cells.select(*rest, *others, axis, F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("step"))
    return out.withColumn(axis, F.col(axis) + F.col("step"))


def dilate(cells: DataFrame, radius: int, keys: tuple[str, ...] = (), disc: bool = False) -> DataFrame:
    if disc or radius <= 2:
        return _spread(cells, radius, keys, disc).distinct()
    # a wide square is a row of cells, spread along the columns
    for axis in ("row", "col"):
        cells = _along(cells, radius, axis, *keys).drop("step").distinct()
    return cells.select(*keys, "row", "col")


def dilate_max(cells: DataFrame, radius: int, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells and their neighbours with the largest value around."""
    return _spread(cells, radius, keys, False, value).groupBy(*keys, "row", "col").agg(F.max(value).alias(value))


def erode(cells: DataFrame, radius: int, keys: tuple[str, ...] = (), disc: bool = False) -> DataFrame:
    """Cells whose whole neighbourhood is there."""
    if not disc and radius > 2:
        cells = cells.select(*keys, "row", "col").distinct()
        for axis in ("row", "col"):
            cells = _along(cells, radius, axis, *keys).groupBy(*keys, "row", "col").agg(F.count("*").alias("seen")).where(F.col("seen") == 2 * radius + 1).drop("seen")
        return cells
    n = sum(1 for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if not disc or i * i + j * j <= radius * radius)
    return _spread(cells.select(*keys, "row", "col").distinct(), radius, keys, disc).groupBy(*keys, "row", "col").agg(F.count("*").alias("seen")).where(F.col("seen") == n).drop("seen")


def close(cells: DataFrame, radius: int, keys: tuple[str, ...] = (), disc: bool = False) -> DataFrame:
    return erode(dilate(cells, radius, keys, disc), radius, keys, disc)


def open_up(cells: DataFrame, radius: int, keys: tuple[str, ...] = (), disc: bool = False) -> DataFrame:
    """Cells of a region that a square (or disc) inside it covers: what is narrower goes."""
    return dilate(erode(cells, radius, keys, disc), radius, keys, disc)


def gaussian_blur(cells: DataFrame, radii: tuple[int, int], sigma: float, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, row, col, value: weighted sums over so many rows and columns around; a cell that isn't there counts 0, and cells around the given ones get values too."""
    out = cells.select(*keys, "row", "col", value)
    for axis, radius in zip(("row", "col"), radii, strict=True):
        if radius:
            total = sum(math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1))
            weight = F.exp(-F.col("step") * F.col("step") / (2.0 * sigma * sigma)) / total
            out = _along(out, radius, axis, *keys, value).groupBy(*keys, "row", "col").agg(F.sum(weight * F.col(value)).alias(value))
    return out


def fill_holes(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The cells and all that they enclose: cells from which no walk by sides leads around them.

    Works on gaps within rows instead of cells: gaps of neighbouring rows that
    overlap are linked, and those whose component touches what lies before a
    row's first or after its last cell are open.
    """
    own = cut(cells.select(*keys, "row", "col").distinct())
    by_row = W.partitionBy(*keys, "row").orderBy("col")
    gaps = own.withColumn("before", F.lag("col").over(by_row)).where("col - before > 1").select(*keys, "row", (F.col("before") + 1).alias("col"), (F.col("col") - 1).alias("until"))
    gaps = cut(gaps.withColumn("id", cell_id(keys)))
    spans = own.groupBy(*keys, "row").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    beside = gaps.select(*keys, "id", "col", "until", F.explode(F.array(F.col("row") - 1, F.col("row") + 1)).alias("row"))
    leaks = beside.join(spans, [*keys, "row"], "left").where("lo is null or col < lo or until > hi").select("id").distinct()
    below = gaps.select(*keys, (F.col("row") - 1).alias("row"), F.col("id").alias("dst"), F.col("col").alias("from"), F.col("until").alias("to"))
    links = gaps.join(below, [*keys, "row"]).where(F.col("col").between(F.col("from"), F.col("to")) | F.col("from").between(F.col("col"), F.col("until"))).select(F.col("id").alias("src"), "dst")
    parts = components(gaps.select("id"), links)
    closed = parts.join(parts.join(leaks, "id", "left_semi").select("component").distinct(), "component", "left_anti")
    return own.unionByName(gaps.join(closed, "id", "left_semi").select(*keys, "row", F.explode(F.sequence("col", "until")).alias("col")))


def flood(region: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = (), label: str = "room", diagonal: bool = False) -> DataFrame:
    """keys, row, col, label: cells of a region by the seed whose flood reaches them first; cells that none reaches have no row.

    Floods advance a step a round, over sides or also corners; a cell reached by
    two at once goes to the smaller label.  Neighbours of a round's cells were
    reached in it, or one round before or after, so a round meets the last two
    only, not all that is flooded already.
    """
    names = [*keys, "row", "col"]
    open_cells = cut(region.select(*names).distinct())
    front = cut(seeds.groupBy(*names).agg(F.min(label).alias(label)))
    done, recent, last = [], [front], None
    while not front.isEmpty():
        seen = front.select(*names) if last is None else front.select(*names).unionByName(last.select(*names))
        ahead = _spread(front, 1, keys, not diagonal, label).groupBy(*names).agg(F.min(label).alias(label))
        last, front = front, cut(ahead.join(open_cells, names).join(seen, names, "left_anti"))
        recent.append(front)
        if len(recent) == 16:  # few tables, however many rounds
            done, recent = [*done, cut(reduce(DataFrame.unionByName, recent))], []
    return reduce(DataFrame.unionByName, [*done, *recent])


def box_mean(cells: DataFrame, radius: int, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of a value over each cell's neighbours that are there."""
    around = _spread(cells, radius, keys, False, value).groupBy(*keys, "row", "col").agg(F.avg(value).alias(value))
    return cells.select(*keys, "row", "col").join(around, [*keys, "row", "col"])


def weighted_mean(cells: DataFrame, radius: int, sigma: float, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Gaussian blur: mean of a value over each cell's neighbours that are there, weighted by distance."""
    near = cells.select(*keys, "row", "col", value, F.explode(_offsets(radius, False)).alias("o"))
    weight = F.exp(-(F.col("o.i") * F.col("o.i") + F.col("o.j") * F.col("o.j")) / (2.0 * sigma * sigma))
    spread = near.select(*keys, (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), weight.alias("weight"), value)
    blurred = spread.groupBy(*keys, "row", "col").agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias(value))
    return cells.select(*keys, "row", "col").join(blurred, [*keys, "row", "col"])


def median(cells: DataFrame, radius: int, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Median of a value over each cell's neighbours that are there (the mean of both middle ones)."""
    around = _spread(cells, radius, keys, False, value).groupBy(*keys, "row", "col").agg(F.median(value).alias(value))
    return cells.select(*keys, "row", "col").join(around, [*keys, "row", "col"])


def top_down(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points seen from above: their distinct places in x and z."""
    return points.select(*keys, "x", "z").distinct()


def subtract(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return a.join(b, [*keys, "row", "col"], "left_anti")


def boundary(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells of a region that erosion removes."""
    return subtract(cells.select(*keys, "row", "col"), erode(cells, 1, keys), keys)


def free_cells(region: DataFrame, poses: DataFrame, obstacles: DataFrame, pose_radius: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Region and discs around poses, without obstacles: the largest connected part of each key."""
    open_cells = region.select(*keys, "row", "col").unionByName(dilate(poses.select(*keys, "row", "col"), pose_radius, keys, disc=True)).distinct()
    parts = cell_components(subtract(open_cells, obstacles, keys), keys)
    size = parts.groupBy(*keys, "component").agg(F.count("*").alias("size"))
    best = size.groupBy(*keys).agg(F.min_by("component", F.struct(-F.col("size"), F.col("component"))).alias("component")) if keys else size.agg(F.min_by("component", F.struct(-F.col("size"), F.col("component"))).alias("component"))
    return parts.join(best, [*keys, "component"], "left_semi").drop("component")


def cell_id(keys: tuple[str, ...]) -> Column:
    """A text for each cell: its keys, row and column, so that cells of different keys never meet."""
    return F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys], F.col("row").cast("string"), F.col("col").cast("string"))


def cell_components(cells: DataFrame, keys: tuple[str, ...] = (), diagonal: bool = True) -> DataFrame:
    """keys, row, col, component: 8- or 4-connected components of the cells of each key, named by their least cell (as text, see cell_id)."""
    rows = cut(cells.select(*keys, "row", "col").distinct().withColumn("id", cell_id(keys)))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    next_cells = rows.select(*keys, F.col("id").alias("src"), "row", "col", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("o"))
    next_cells = next_cells.select(*keys, "src", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    edges = next_cells.join(rows.withColumnRenamed("id", "dst"), [*keys, "row", "col"]).select("src", "dst")
    return rows.join(components(rows.select("id"), edges), "id").select(*keys, "row", "col", "component")


def ranked_component(cells: DataFrame, rank: int = 1, keys: tuple[str, ...] = (), diagonal: bool = True) -> DataFrame:
    """keys, row, col of each key's component that is ``rank``-th by size; of equal sizes the least name comes first."""
    parts = cut(cell_components(cells, keys, diagonal))
    sizes = parts.groupBy(*keys, "component").agg(F.count("*").alias("size"))
    order = W.partitionBy(*keys).orderBy(F.desc("size"), "component")
    chosen = sizes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == rank).select(*keys, "component")
    return parts.join(chosen, [*keys, "component"], "left_semi").drop("component")


def signed_distance(cells: DataFrame, reach: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, row, col, distance: of a region's cells to the nearest cell outside it, of cells around it (within ``reach``) to the nearest inside, negative."""
    own = cut(cells.select(*keys, "row", "col").distinct())
    inside = nearest_wall(own, keys).select(*keys, "row", "col", F.sqrt("d2").alias("distance"))
    at = lambda df, name: df.select(*keys, "row", "col", F.col("row").cast("double").alias("x"), F.col("col").cast("double").alias("z"), cell_id(keys).alias(name))
    around = cut(at(subtract(dilate(own, reach, keys), own, keys), "cell"))
    near = nearest(around.select(*keys, "cell", "x", "z"), at(own, "inner").select(*keys, "inner", "x", "z"), "cell", "inner", 2.0, keys, ("x", "z")).drop(*keys)
    outside = around.join(near, "cell").select(*keys, "row", "col", (-F.col("distance")).alias("distance"))
    return inside.unionByName(outside)


def nearest_wall(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each cell the nearest cell outside the region (wall_row, wall_col) and its squared distance.

    Walls spread inward: in each round a cell hears its 8 neighbours' walls and
    keeps the nearest, as long as any gets nearer.
    """
    own = cut(cells.select(*keys, "row", "col").distinct())
    rim = subtract(dilate(own, 1, keys), own, keys).select(*keys, F.col("row").alias("wall_row"), F.col("col").alias("wall_col"), "row", "col")
    known = None
    front = rim
    d2 = (F.col("row") - F.col("wall_row")) * (F.col("row") - F.col("wall_row")) + (F.col("col") - F.col("wall_col")) * (F.col("col") - F.col("wall_col"))
    while True:
        heard = _spread(front, 1, keys, False, "wall_row", "wall_col").join(own, [*keys, "row", "col"], "left_semi").withColumn("d2", d2)
        if known is not None:
            heard = heard.unionByName(known)
        best = cut(heard.groupBy(*keys, "row", "col").agg(F.min(F.struct("d2", "wall_row", "wall_col")).alias("w")).select(*keys, "row", "col", "w.wall_row", "w.wall_col", "w.d2"))
        changed = best if known is None else best.join(known, [*keys, "row", "col", "wall_row", "wall_col"], "left_anti")
        front = changed.select(*keys, "wall_row", "wall_col", "row", "col")
        known = best
        if front.isEmpty():
            return known


def otsu(hist: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, threshold: the bin (of columns bin, n) that separates two classes with the largest variance between them."""
    w, all_w = W.partitionBy(*keys).orderBy("bin"), W.partitionBy(*keys)
    moment = F.col("bin") * F.col("n")
    h = hist.withColumn("w0", F.sum("n").over(w)).withColumn("m0", F.sum(moment).over(w)).withColumn("w1", F.sum("n").over(all_w) - F.col("w0")).withColumn("m1", F.sum(moment).over(all_w) - F.col("m0"))
    gap = F.col("m0") / F.col("w0") - F.col("m1") / F.col("w1")
    h = h.where("w1 > 0").withColumn("between", F.col("w0") * F.col("w1") * gap * gap)
    return h.groupBy(*keys).agg(F.min_by("bin", F.struct(-F.col("between"), F.col("bin"))).alias("threshold"))


def segment_rooms(region: DataFrame, seed_distance: float, keys: tuple[str, ...] = (), least_seed: int = 1) -> DataFrame:
    """Rooms of a floor's free cells: parts farther than ``seed_distance`` cells from any wall are seeds, other cells join the seed that reaches them first.

    keys, row, col, room.  Seeds grow by rounds over the free cells, as water
    rises from them; a cell reached by two at once goes to the smaller one.
    """
    walls = nearest_wall(region, keys)
    deep = walls.where(F.col("d2") >= seed_distance * seed_distance).select(*keys, "row", "col")
    seeds = cell_components(deep, keys)
    size = seeds.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least_seed).select("component")
    rooms = seeds.join(size, "component", "left_semi").select(*keys, "row", "col", F.col("component").alias("room"))
    return flood(region, rooms, keys, diagonal=True)


def medial_edges(walls: DataFrame, apart: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges of the medial axis: neighbouring cells both of which see walls that are ``apart`` cells from a neighbour's wall."""
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)]
    cells = cut(walls.withColumn("id", cell_id(keys)))
    pairs = cells.select(*keys, F.col("id").alias("src"), F.col("wall_row").alias("wr"), F.col("wall_col").alias("wc"), "row", "col", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("o"))
    pairs = pairs.select(*keys, "src", "wr", "wc", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), F.sqrt((F.col("o.i") * F.col("o.i") + F.col("o.j") * F.col("o.j")).cast("double")).alias("dist"))
    met = pairs.join(cells.withColumnRenamed("id", "dst"), [*keys, "row", "col"])
    gap2 = (F.col("wr") - F.col("wall_row")) * (F.col("wr") - F.col("wall_row")) + (F.col("wc") - F.col("wall_col")) * (F.col("wc") - F.col("wall_col"))
    ridge = cut(met.where(gap2 >= apart * apart).select(*keys, "src", "dst", "dist"))
    on = ridge.select("src").union(ridge.select("dst")).distinct().withColumnRenamed("src", "id")
    return met.join(on, met.src == on.id, "left_semi").join(on, met.dst == on.id, "left_semi").select(*keys, "src", "dst", "dist")
