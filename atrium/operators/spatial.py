"""Spatial aggregation and joins over point tables (columns x, y, z and ids).

Neighbour joins deal both sides by grid cell: a probe point looks into the
cells around its own, so candidates meet by equi-join and no pair of distant
points is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geometry import voxel
from ..session import cut
from . import tiles

AXES = ("x", "y", "z")


def voxel_downsample(points: DataFrame, size: float, keys: tuple[str, ...] = (), mean: tuple[str, ...] = AXES, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Mean of the given columns and count of points in each voxel."""
    cells = [voxel(F.col(a), size).alias(f"v{a}") for a in axes]
    return points.groupBy(*keys, *cells).agg(*[F.avg(c).alias(c) for c in mean], F.count("*").alias("n_points"))


def bounds(points: DataFrame, keys: tuple[str, ...], axes: tuple[str, ...] = AXES) -> DataFrame:
    """Axis-aligned bounds by key: x0, x1, y0, ..."""
    return points.groupBy(*keys).agg(*[f(a).alias(f"{a}{i}") for a in axes for i, f in ((0, F.min), (1, F.max))], F.count("*").alias("n_points"))


def _cells(df: DataFrame, size: float, axes: tuple[str, ...]) -> list[Column]:
    return [voxel(F.col(a), size).alias(f"c{a}") for a in axes]


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """df over as many partitions as the session's shuffles have, however few bytes it has before it is exploded."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _around(df: DataFrame, size: float, axes: tuple[str, ...], reach: int = 1) -> DataFrame:
    """Each row once for every cell within reach of its own."""
    out = df.select("*", *_cells(df, size, axes))
    for a in axes:
        out = out.withColumn(f"c{a}", F.explode(F.sequence(F.col(f"c{a}") - reach, F.col(f"c{a}") + reach)))
    return out


def finite(df: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Rows whose coordinates are all numbers: those that are null, NaN or infinite are near nothing."""
    cond = F.lit(True)
    for a in axes:
        cond = cond & F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) & (F.abs(F.col(a)) < float("inf"))
    return df.where(cond)


def keyed(keys: tuple[str, ...], name: str) -> Column:
    """An id that differs between keys (such as scenes), so that ids which repeat over keys don't mix."""
    return F.struct(*keys, name) if keys else F.col(name)


def _equal(keys: tuple[str, ...], a: str, b: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return cond


def _distance2(axes: tuple[str, ...], a: str, b: str) -> Column:
    total = F.lit(0.0)
    for x in axes:
        d = F.col(f"{a}.{x}") - F.col(f"{b}.{x}")
        total = total + d * d
    return total


def within_radius(left: DataFrame, right: DataFrame, radius: float, keys: tuple[str, ...] = (), axes: tuple[str, ...] = AXES, strict: bool = True) -> DataFrame:
    """Pairs of rows (structs l and r) less than radius apart, of equal keys; rows without finite coordinates have none."""
    a = _around(finite(left, axes), radius, axes).alias("l")
    b = finite(right, axes).select("*", *_cells(right, radius, axes)).alias("r")
    on = [F.col(f"l.c{x}") == F.col(f"r.c{x}") for x in axes] + [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    d2 = _distance2(axes, "l", "r")
    return a.join(b, cond).where(d2 < radius * radius if strict else d2 <= radius * radius).select(F.struct(*[F.col(f"l.{c}") for c in left.columns]).alias("l"), F.struct(*[F.col(f"r.{c}") for c in right.columns]).alias("r"), d2.alias("d2"))


#: Cells of a level are so many times as wide as those of the level below.
_WIDER = 4


def _grid(left: DataFrame, right: DataFrame, k: int, cell: float, axes: tuple[str, ...]) -> tuple[list[float], float] | None:
    """Origin and width of the finest cells, which hold some k points on average and aren't wider than ``cell``; None if a side is empty."""
    both = left.select(*axes, F.lit(0).alias("is_right")).unionByName(right.select(*axes, F.lit(1).alias("is_right")))
    span = lambda a, f, end: f(F.when(F.col("is_right") == 1, F.col(a).cast("double"))).alias(f"{a}{end}")
    sides = [c for a in axes for c in (F.min(F.col(a).cast("double")).alias(f"{a}0"), span(a, F.min, "min"), span(a, F.max, "max"))]
    row = both.agg(*sides, F.count("*").alias("n"), F.sum("is_right").alias("n_right")).head()
    if not row.n_right or row.n == row.n_right:
        return None
    spans = [row[f"{a}max"] - row[f"{a}min"] for a in axes]
    volume = 1.0
    for span in spans:
        volume *= max(span, max(spans) / 1024)
    finest = (volume * k / row.n_right) ** (1 / len(axes))
    return [row[f"{a}0"] for a in axes], max(min(cell, finest or cell), max(spans) / 2.0**40)


def _box_of(axes: tuple[str, ...]) -> list[Column]:
    return [f(a).alias(f"{a}{i}") for a in axes for i, f in ((0, F.min), (1, F.max))]


def _pyramid(goals: DataFrame, keys: tuple[str, ...], base: list[str], axes: tuple[str, ...]) -> DataFrame:
    """level, keys, cells, n and bounds of the points in each cell of each level; the top has one cell for each of the keys."""
    edge = [*[F.min(f"{a}0").alias(f"{a}0") for a in axes], *[F.max(f"{a}1").alias(f"{a}1") for a in axes]]
    now = goals.groupBy(*keys, *base).agg(F.count("*").alias("n"), *_box_of(axes))
    every, level = None, 0
    while True:
        now = cut(now)
        every = now.withColumn("level", F.lit(level)) if every is None else every.unionByName(now.withColumn("level", F.lit(level)))
        if not now.agg(F.max(F.greatest(*base) if len(base) > 1 else F.col(base[0])).alias("m")).head().m:
            return every
        level += 1
        now = now.withColumns({c: F.floor(F.col(c) / _WIDER).cast("long") for c in base}).groupBy(*keys, *base).agg(F.sum("n").alias("n"), *edge)


def k_nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int, cell: float, keys: tuple[str, ...] = (), axes: tuple[str, ...] = AXES) -> DataFrame:
    """keys, left_id, right (struct), d2, rank: the k nearest right points of equal keys, ranked by distance and id; all of them where there are fewer.

    Right points are counted in cells, cells in cells four times as wide, up to
    one that holds all, each with the bounds of its points.  Probes of one finest
    cell descend together: of the cells below those that they still look into,
    the least far ones that hold k points bound the k-th distance, and cells
    whose nearest edge is beyond it are left.  At last the probes meet the
    points of the cells that remain, few however far away they are.  Of right
    points at one place only the k of least id are read.  ``cell`` is the
    greatest width of the finest cells.  Rows without finite coordinates, and
    probes without any right point of equal keys, get no row.
    """
    probes, goals = finite(left, axes), finite(right, axes)
    grid = _grid(probes, goals, k, cell, axes)
    named = [*keys, left_id]
    if grid is None:
        none = probes.limit(0).join(goals.limit(0).select(F.struct(*[F.col(c).alias(c) for c in right.columns]).alias("right")))
        return none.select(*named, "right", F.lit(0.0).alias("d2"), F.lit(0).alias("rank"))
    origin, finest = grid
    base = [f"_c{a}" for a in axes]
    placed = lambda df: df.withColumns({c: F.floor((F.col(a) - o) / finest).cast("long") for c, a, o in zip(base, axes, origin, strict=True)})
    copies = W.partitionBy(*keys, *axes).orderBy(right_id)
    goals = cut(placed(goals.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy")))
    probes = cut(placed(probes))
    pyramid = _pyramid(goals, keys, base, axes)
    groups = probes.groupBy(*keys, *base).agg(*_box_of(axes)).select(*keys, F.struct(*base).alias("group"), *[F.col(f"{a}{i}").alias(f"g_{a}{i}") for a in axes for i in (0, 1)])
    looks = groups.select("*", *[F.lit(0).cast("long").alias(c) for c in base])
    by = W.partitionBy(*keys, "group")
    top = pyramid.agg(F.max("level")).head()[0]
    near, far = F.lit(0.0), F.lit(0.0)
    for a in axes:
        gap = F.greatest(F.lit(0.0), F.col(f"g_{a}0") - F.col(f"{a}1"), F.col(f"{a}0") - F.col(f"g_{a}1"))
        span = F.greatest(F.col(f"g_{a}1") - F.col(f"{a}0"), F.col(f"{a}1") - F.col(f"g_{a}0"))
        near, far = near + gap * gap, far + span * span
    for level in range(top - 1, -1, -1):
        below = pyramid.where(F.col("level") == level).drop("level")
        below = below.withColumns({f"_p{c}": F.floor(F.col(c) / _WIDER).cast("long") for c in base})
        ups = looks.withColumnsRenamed({c: f"_p{c}" for c in base})
        met = ups.join(below, [*keys, *[f"_p{c}" for c in base]]).withColumn("_near", near).withColumn("_far", far)
        held = F.sum("n").over(by.orderBy("_far").rangeBetween(W.unboundedPreceding, W.currentRow))
        bound = F.min(F.when(F.col("_held") >= k, F.col("_far"))).over(by)
        met = met.withColumn("_held", held).withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound") * (1 + 1e-12)))
        looks = cut(met.select(*groups.columns, *base))
    asked = probes.withColumn("group", F.struct(*base)).drop(*base).join(looks.select(*keys, "group", *base), [*keys, "group"]).alias("l")
    d2 = _distance2(axes, "l", "r").alias("d2")
    found = asked.join(goals.alias("r"), _equal((*keys, *base), "l", "r")).select(*[F.col(f"l.{c}") for c in named], F.struct(*[F.col(f"r.{c}").alias(c) for c in right.columns]).alias("right"), d2)
    if k == 1:
        best = F.min_by("right", F.struct("d2", F.col(f"right.{right_id}"))).alias("right")
        return found.groupBy(*named).agg(best, F.min("d2").alias("d2")).select(*named, "right", "d2", F.lit(1).alias("rank"))
    ranked_by = W.partitionBy(*named).orderBy("d2", F.col(f"right.{right_id}"))
    return found.withColumn("rank", F.row_number().over(ranked_by)).where(F.col("rank") <= k).select(*named, "right", "d2", "rank")


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float, keys: tuple[str, ...] = (), axes: tuple[str, ...] = AXES) -> DataFrame:
    """keys, left_id, right_id and distance of the nearest right point of equal keys; ties go to the smaller id.

    As k_nearest() with k = 1; ids may repeat over keys.
    """
    near = k_nearest(left, right.select(*keys, right_id, *axes), left_id, right_id, 1, cell, keys, axes)
    return near.select(*keys, left_id, F.col(f"right.{right_id}").alias(right_id), F.sqrt("d2").alias("distance"))


def knn_vote(left: DataFrame, right: DataFrame, left_id: str, right_id: str, label: str, k: int, cell: float, axes: tuple[str, ...] = AXES, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, left_id, majority label of the k nearest labelled points and its votes; ties go to the smallest label."""
    near = k_nearest(left, right.select(*keys, right_id, label, *axes), left_id, right_id, k, cell, keys, axes)
    votes = near.groupBy(*keys, left_id, F.col(f"right.{label}").alias(label)).agg(F.count("*").alias("votes"))
    best = F.min_by(F.struct(label, "votes"), F.struct(-F.col("votes"), F.col(label)))
    return votes.groupBy(*keys, left_id).agg(best.alias("best")).select(*keys, left_id, F.col(f"best.{label}").alias(label), F.col("best.votes").alias("votes"))


def transfer_labels(left: DataFrame, right: DataFrame, left_id: str, right_id: str, labels: tuple[str, ...], cell: float, keys: tuple[str, ...] = (), axes: tuple[str, ...] = AXES, within: float | None = None) -> DataFrame:
    """keys, left_id and the labels of the nearest right point of equal keys; with ``within``, null if that is farther."""
    near = k_nearest(left, right.select(*keys, right_id, *labels, *axes), left_id, right_id, 1, cell, keys, axes)
    far = F.lit(False) if within is None else F.sqrt("d2") > within
    return near.select(*keys, left_id, *[F.when(~far, F.col(f"right.{c}")).alias(c) for c in labels])


def overlap_ratio(points: DataFrame, pairs: DataFrame, segment: str, point: str, radius: float, how: str = "max", axes: tuple[str, ...] = AXES, keys: tuple[str, ...] = ()) -> DataFrame:
    """For pairs (keys, a, b) of segments the share of points with a neighbour of the other one within a radius.

    how: "max" of both shares, "sum" (matched of both over points of both), or
    "one_sided" (points of a near b over points of b, which may exceed 1).
    keys: such as the scene; segments and points of one number in two of them
    are different ones.  Points without finite coordinates count in their
    segment, but are near nothing.
    """
    sizes = points.groupBy(*keys, segment).agg(F.count("*").alias("n"))
    rows = finite(points, axes).select(*keys, F.lit(0).alias("side"), F.col(segment).alias("a"), F.col(point).alias("point"), *axes)
    paired = cut(pairs.select(*keys, "a").union(pairs.select(*keys, "b")).distinct())
    near = cut(tiles.near_numbers(rows.join(paired, [*keys, "a"], "left_semi"), radius, keys, axes, False))
    one = lambda a, b, n: near.select(*keys, F.col("a").alias(a), F.col("b").alias(b), F.col("n").alias(n))
    total = lambda x, n: sizes.select(*keys, F.col(segment).alias(x), F.col("n").alias(n))
    both = pairs.select(*keys, "a", "b").join(one("a", "b", "na"), [*keys, "a", "b"], "left").join(one("b", "a", "nb"), [*keys, "a", "b"], "left").fillna(0, ["na", "nb"])
    both = both.join(total("a", "ta"), [*keys, "a"]).join(total("b", "tb"), [*keys, "b"])
    score = {"max": F.greatest(F.col("na") / F.col("ta"), F.col("nb") / F.col("tb")), "sum": (F.col("na") + F.col("nb")) / (F.col("ta") + F.col("tb")), "one_sided": F.col("na") / F.col("tb")}[how]
    return both.select(*keys, "a", "b", score.alias("overlap"))


def contacts(points: DataFrame, segment: str, point: str, radius: float, axes: tuple[str, ...] = AXES, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, a, point, b: each point of a segment a with each other segment b (of equal keys) that has a point less than radius away.

    Cells as wide as the radius are paired first, by the boxes of what they
    hold.  Boxes that are too far apart drop out; where even the farthest
    corners are near, a cell's segments are in contact with all points of the
    other without any distance; only what is left meets point by point.
    """
    names = [f"c{a}" for a in axes]
    rows = finite(points, axes).select(*keys, F.col(segment).alias("a"), F.col(point).alias("point"), *axes, *_cells(points, radius, axes))
    boxes = cut(rows.groupBy(*keys, *names).agg(*[f(a).cast("double").alias(f"{a}{i}") for a in axes for i, f in ((0, F.min), (1, F.max))]))
    here = boxes
    for a in axes:
        here = here.withColumn(f"d{a}", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    here = here.select(*boxes.columns, *[(F.col(f"c{a}") + F.col(f"d{a}")).alias(f"o{a}") for a in axes]).alias("l")
    cond = _equal(keys, "l", "r")
    near, far = F.lit(0.0), F.lit(0.0)
    for a in axes:
        cond = cond & (F.col(f"l.o{a}") == F.col(f"r.c{a}"))
        gap = F.greatest(F.lit(0.0), F.col(f"l.{a}0") - F.col(f"r.{a}1"), F.col(f"r.{a}0") - F.col(f"l.{a}1"))
        span = F.greatest(F.col(f"l.{a}1") - F.col(f"r.{a}0"), F.col(f"r.{a}1") - F.col(f"l.{a}0"))
        near, far = near + gap * gap, far + span * span
    others = [f"o{a}" for a in axes]
    met = here.join(boxes.alias("r"), cond).where(near < radius * radius).select(*[F.col(f"l.{k}") for k in keys], *[F.col(f"l.{c}") for c in (*names, *others)], (far < radius * radius).alias("sure"))
    probes = cut(rows).join(met, [*keys, *names]).select(*keys, "a", "point", *axes, *others, "sure").alias("l")
    held = rows.select(*keys, "a", *names).distinct().alias("r")
    there = _equal(keys, "l", "r")
    for a in axes:
        there = there & (F.col(f"l.o{a}") == F.col(f"r.c{a}"))
    other = F.col("l.a") != F.col("r.a")
    out = [*[F.col(f"l.{k}") for k in keys], F.col("l.a"), F.col("l.point"), F.col("r.a").alias("b")]
    sure = probes.where("sure").join(held, there & other).select(*out)
    d2 = _distance2(axes, "l", "r")
    rest = probes.where("not sure").join(rows.alias("r"), there & other).where(d2 < radius * radius).select(*out)
    return sure.unionByName(rest).distinct()


def near_counts(left: DataFrame, right: DataFrame, a: str, b: str, point: str, radius: float, keys: tuple[str, ...] = (), axes: tuple[str, ...] = AXES) -> DataFrame:
    """keys, a, b, na, nb: how many points of each group a of the left table have a neighbour in group b of the right one, and the other way."""
    rows = lambda df, group, side: finite(df, axes).select(*keys, F.lit(side).alias("side"), F.col(group).alias("a"), F.col(point).alias("point"), *axes)
    near = cut(tiles.near_numbers(rows(left, a, 0).unionByName(rows(right, b, 1)), radius, keys, axes, True))
    one = lambda side, x, y, n: near.where(F.col("side") == side).select(*keys, F.col("a").alias(x), F.col("b").alias(y), F.col("n").alias(n))
    return one(0, a, b, "na").join(one(1, b, a, "nb"), [*keys, a, b])


def _levels(boxes: DataFrame, cell: float) -> DataFrame:
    """boxes with ``level``: the least doubling of the cell that is no shorter than the box's longest side."""
    side = F.greatest(*[F.col(f"{x}1") - F.col(f"{x}0") for x in AXES])
    return boxes.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(cell)) / cell))).cast("int"))


def _covering(boxes: DataFrame, levels: list[int], cell: float, prefix: str, keys: tuple[str, ...], reach: str) -> DataFrame:
    """Each box once for each cell that it covers (at most two an axis) of the levels ``reach``: its "own", all "above" that, or "both"."""
    wanted = {"own": lambda x: x == F.col("level"), "above": lambda x: x > F.col("level"), "both": lambda x: x >= F.col("level")}[reach]
    names = [f"{x}{i}" for x in AXES for i in (0, 1)]
    cells = boxes.select(*keys, F.col("box").alias(f"{prefix}_box"), *[F.col(c).alias(f"{prefix}_{c}") for c in names], F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), wanted)).alias("at"))
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("at"))
    for x in AXES:
        cells = cells.withColumn(f"c{x}", F.explode(F.sequence(F.floor(F.col(f"{prefix}_{x}0") / size).cast("long"), F.floor(F.col(f"{prefix}_{x}1") / size).cast("long"))))
    return cells


def box_pairs(left: DataFrame, right: DataFrame, a: str, b: str, cell: float, least: float, keys: tuple[str, ...] = (), once: bool = False) -> DataFrame:
    """keys, a, b, iou: pairs of boxes (x0..z1) of two tables, of equal keys, whose IoU exceeds ``least``; once: a < b only.

    Boxes are dealt to the cells of a grid as wide as the larger of both, so a
    box of any size covers at most two cells an axis, and a pair is kept in the
    cell where its overlap's lower corner lies.  Left boxes at their own level
    meet right ones of that level or below, and left ones below meet right ones
    at their own: boxes smaller than a level never meet each other there.
    Boxes with bounds that aren't finite meet none.
    """
    bounds_of = tuple(f"{x}{i}" for x in AXES for i in (0, 1))
    # few bytes of boxes make very many pairs, so they are dealt over all tasks first
    left, right = (_dealt(_levels(finite(df, bounds_of).withColumn("box", F.col(c)), cell), "box") for df, c in ((left, a), (right, b)))
    # one number a doubling of size reaches the driver: some 60 at most
    levels = sorted({r.level for df in (left, right) for r in df.select("level").distinct().collect()})
    met = _meeting(_covering(left, levels, cell, "l", keys, "own"), _covering(right, levels, cell, "r", keys, "both"), cell, keys, once)
    if len(levels) > 1:
        met = met.unionByName(_meeting(_covering(left, levels, cell, "l", keys, "above"), _covering(right, levels, cell, "r", keys, "own"), cell, keys, once))
    return met.select(*keys, F.col("l_box").alias(a), F.col("r_box").alias(b), "iou").where(F.col("iou") > least)


def _meeting(l: DataFrame, r: DataFrame, cell: float, keys: tuple[str, ...], once: bool) -> DataFrame:
    """keys, l_box, r_box, iou of boxes that touch, each pair in one cell."""
    size = F.lit(cell) * F.pow(F.lit(2.0), l["at"])
    cond = l["at"] == r["at"]
    for k in keys:
        cond = cond & (l[k] == r[k])
    for x in AXES:
        low, high = F.greatest(F.col(f"l_{x}0"), F.col(f"r_{x}0")), F.least(F.col(f"l_{x}1"), F.col(f"r_{x}1"))
        cond = cond & (l[f"c{x}"] == r[f"c{x}"]) & (low <= high) & (l[f"c{x}"] == F.floor(low / size).cast("long"))
    if once:
        cond = cond & (F.col("l_box") < F.col("r_box"))
    side = lambda x: F.least(F.col(f"l_{x}1"), F.col(f"r_{x}1")) - F.greatest(F.col(f"l_{x}0"), F.col(f"r_{x}0"))
    volume = lambda s: (F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0")) * (F.col(f"{s}_z1") - F.col(f"{s}_z0"))
    inter = side("x") * side("y") * side("z")
    union = volume("l") + volume("r") - inter
    iou = F.when(union > 0, inter / union).otherwise(F.lit(0.0))
    return l.join(r, cond).select(*[l[k] for k in keys], "l_box", "r_box", iou.alias("iou"))


def iou_pairs(boxes: DataFrame, key: str, cell: float, least: float) -> DataFrame:
    """Pairs a < b of boxes (x0..z1) of one table whose IoU exceeds ``least``."""
    one = lambda c: boxes.withColumnRenamed(key, c)
    return box_pairs(one("a"), one("b"), "a", "b", cell, least, (), True)


def extrude(cells: DataFrame, low: Column, high: Column, step: float) -> DataFrame:
    """Each floor cell once for every level from low to high."""
    return cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.floor((high - low) / step).cast("int")))).withColumn("y", low + F.col("level") * step)


def crop(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Points in a box, bounds included; none if the box is degenerate."""
    if any(a >= b for a, b in zip(low, high, strict=True)):
        return points.limit(0)
    cond = F.lit(True)
    for axis, a, b in zip(AXES, low, high, strict=True):
        cond = cond & F.col(axis).between(a, b)
    return points.where(cond)


def interval_join(rows: DataFrame, intervals: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Rows with low < value < high; the intervals are one small table of floors."""
    return rows.join(intervals, (F.col(value) > F.col(low)) & (F.col(value) < F.col(high)))
