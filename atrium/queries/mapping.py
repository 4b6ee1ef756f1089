"""Masks, ground truth, merging, navigation and searches that need more than one operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.phrases import ASKED_ROOMS, UNASKED_OBJECTS, asked_categories
from ..functions.vector import as_doubles
from ..operators import cells, clustering, graph, masks, ordered, raster, spatial
from ..plans import navigation, scene, search
from ..session import cut
from .tables import OBJECTS, POINTS, POSES, PROTOTYPES, Registry, objects, points, poses, prototypes, scene_of, table

REGISTRY = Registry()
_SIM = "list_dot_product(CAST(embedding AS DOUBLE[]), query)"

# Pixels: a frame is an order, a mask a line number, an image 3 x 3.
_PIXELS = "px AS (SELECT DISTINCT l_orderkey AS frame_id, CAST(l_linenumber AS BIGINT) AS mask_id, l_partkey % 3 AS row, l_suppkey % 3 AS col FROM lineitem)"


def _pixels(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").cast("long").alias("mask_id"), (F.col("l_partkey") % 3).alias("row"), (F.col("l_suppkey") % 3).alias("col")).distinct()


@REGISTRY.add("a6_pixel_features", f"""WITH {_PIXELS}, f AS (SELECT vec_id AS mask_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
s AS (SELECT frame_id, row, col, pos, sum(v) AS v FROM px JOIN f USING (mask_id) GROUP BY 1, 2, 3, 4), n AS (SELECT frame_id, row, col, sqrt(sum(v * v)) AS norm FROM s GROUP BY 1, 2, 3)
SELECT frame_id, row, col, round(max(CASE WHEN pos = 1 THEN v / norm END), 6) AS e0, round(max(CASE WHEN pos = 2 THEN v / norm END), 6) AS e1 FROM s JOIN n USING (frame_id, row, col) GROUP BY 1, 2, 3""")
def a6(spark, sf_dir):
    features = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("mask_id"), "embedding")
    out = masks.pixel_features(_pixels(spark, sf_dir), features, of=())
    return out.select("frame_id", "row", "col", F.round(F.col("embedding")[0], 6).alias("e0"), F.round(F.col("embedding")[1], 6).alias("e1"))


@REGISTRY.add("f17_masks_without_contained", f"""WITH {_PIXELS}, size AS (SELECT frame_id, mask_id, count(*) AS n FROM px GROUP BY 1, 2), sh AS (SELECT a.frame_id, a.mask_id AS o, b.mask_id AS i, count(*) AS n FROM px a JOIN px b ON a.frame_id = b.frame_id AND a.row = b.row AND a.col = b.col AND a.mask_id <> b.mask_id GROUP BY 1, 2, 3),
c AS (SELECT sh.frame_id, o, i FROM sh JOIN size si ON si.frame_id = sh.frame_id AND si.mask_id = i JOIN size so ON so.frame_id = sh.frame_id AND so.mask_id = o WHERE sh.n = si.n AND (so.n > si.n OR o < i)),
gone AS (SELECT DISTINCT c.frame_id, o AS mask_id, row, col FROM c JOIN px ON px.frame_id = c.frame_id AND px.mask_id = i) SELECT frame_id, mask_id, row, col FROM px ANTI JOIN gone USING (frame_id, mask_id, row, col)""")
def f17(spark, sf_dir):
    return masks.without_contained(_pixels(spark, sf_dir))


@REGISTRY.add("p13_mask_crops", f"""WITH {_PIXELS}, b AS (SELECT frame_id, mask_id, min(col) AS x, min(row) AS y, max(col) - min(col) + 1 AS w, max(row) - min(row) + 1 AS h FROM px GROUP BY 1, 2), im AS (SELECT DISTINCT frame_id, row, col FROM px)
SELECT frame_id, mask_id, row - y AS row, col - x AS col FROM im JOIN b USING (frame_id) WHERE row BETWEEN y AND y + h - 1 AND col BETWEEN x AND x + w - 1""")
def p13(spark, sf_dir):
    px = _pixels(spark, sf_dir)
    return masks.crop_pixels(px.select("frame_id", "row", "col").distinct(), masks.bounding_boxes(px))


@REGISTRY.add("p17_colourised_ids", """SELECT p_partkey, coalesce(CAST(n_nationkey * 10 AS BIGINT), 0) AS r, coalesce(CAST(n_nationkey * 37 % 256 AS BIGINT), 0) AS g, coalesce(CAST(n_nationkey * 91 % 256 AS BIGINT), 0) AS b FROM part LEFT JOIN nation ON n_nationkey = p_size""")
def p17(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    palette = table(spark, sf_dir, "nation").select(k.alias("id"), (k * 10).alias("r"), (k * 37 % 256).alias("g"), (k * 91 % 256).alias("b"))
    ids = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("id"))
    return masks.colourise(ids, palette).select("p_partkey", "r", "g", "b")


# Coloured clouds: a scene is a supplier, a region a line number, an object one of 25 nations by its colour.
_TRUTH = """pts AS (SELECT l_suppkey AS scene, CAST(l_linenumber AS BIGINT) AS region_id, CAST(l_quantity AS DOUBLE) AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z, l_partkey % 30 AS colour FROM lineitem),
ob AS (SELECT l_suppkey AS scene, CAST(n_nationkey AS BIGINT) AS object_id, lower(n_name) AS category FROM (SELECT DISTINCT l_suppkey FROM lineitem) CROSS JOIN nation),
fl AS (SELECT l_suppkey AS scene, CAST(r_regionkey AS BIGINT) AS floor_id, 2.5 * r_regionkey AS low, 2.5 * (r_regionkey + 1) AS high FROM (SELECT DISTINCT l_suppkey FROM lineitem) CROSS JOIN region),
lb AS (SELECT s_suppkey AS scene, CAST(s_nationkey % 7 + 1 AS BIGINT) AS region_id, 'hall' AS category FROM supplier),
hit AS (SELECT p.*, o.object_id, o.category FROM pts p JOIN ob o ON o.scene = p.scene AND o.object_id = p.colour),
home AS (SELECT scene, object_id, region_id FROM (SELECT scene, object_id, region_id, row_number() OVER (PARTITION BY scene, object_id ORDER BY count(*) DESC, region_id) AS rank FROM hit GROUP BY 1, 2, 3) WHERE rank = 1),
st AS (SELECT scene, region_id, min(y) AS min_height, max(y) AS max_height, avg(y) AS mean_height, count(*) AS n_points FROM pts GROUP BY 1, 2),
rg AS (SELECT st.*, lb.category, floor_id FROM st LEFT JOIN lb USING (scene, region_id) JOIN fl ON fl.scene = st.scene AND mean_height > low AND mean_height < high)"""


def _truth(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    colour = (F.col("l_partkey") % 30) / 255.0
    pts = line.select(F.col("l_suppkey").alias("scene"), F.col("l_linenumber").cast("long").alias("region_id"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"), colour.alias("r"), F.lit(0.0).alias("g"), F.lit(1.0).alias("b"))
    scenes = line.select(F.col("l_suppkey").alias("scene")).distinct()
    k = F.col("n_nationkey").cast("long")
    things = scenes.crossJoin(table(spark, sf_dir, "nation").select(k.alias("object_id"), F.lower("n_name").alias("category"), (k / 255.0).alias("r"), F.lit(0.0).alias("g"), F.lit(1.0).alias("b")))
    f = F.col("r_regionkey").cast("long")
    floors = scenes.crossJoin(table(spark, sf_dir, "region").select(f.alias("floor_id"), (2.5 * f).alias("low"), (2.5 * (f + 1)).alias("high")))
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scene"), (F.col("s_nationkey") % 7 + 1).cast("long").alias("region_id"), F.lit("hall").alias("category"))
    return scene.panoptic_truth(pts, things, floors, labels)


@REGISTRY.add("e11_true_objects", f"""WITH {_TRUTH}, bx AS (SELECT scene, object_id, min(category) AS category, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, count(*) AS n_points FROM hit GROUP BY 1, 2)
SELECT bx.*, region_id, lpad(printf('%X', object_id), 2, '0') || '00FF' AS hex, floor_id FROM bx JOIN home USING (scene, object_id) LEFT JOIN (SELECT scene, region_id, floor_id FROM rg) USING (scene, region_id)""")
def e11_objects(spark, sf_dir):
    return _truth(spark, sf_dir)[0]


@REGISTRY.add("e11_true_regions", f"WITH {_TRUTH} SELECT scene, region_id, min_height, max_height, round(mean_height, 9) AS mean_height, n_points, category, floor_id FROM rg")
def e11_regions(spark, sf_dir):
    return _truth(spark, sf_dir)[1].withColumn("mean_height", F.round("mean_height", 9))


@REGISTRY.add("a15_floor_bounds", f"WITH {_TRUTH} SELECT scene, floor_id, round(avg(min_height), 9) AS lower, round(avg(max_height), 9) AS upper FROM rg GROUP BY 1, 2")
def a15(spark, sf_dir):
    return _truth(spark, sf_dir)[2].select("scene", "floor_id", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


@REGISTRY.add("e12_objects_of_labelled_regions", f"WITH {_TRUTH} SELECT home.scene, home.object_id, home.region_id FROM home SEMI JOIN lb USING (scene, region_id)")
def e12(spark, sf_dir):
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scene"), (F.col("s_nationkey") % 7 + 1).cast("long").alias("region_id"))
    return scene.objects_by(_truth(spark, sf_dir)[0], labels, "region_id").select("scene", "object_id", "region_id")


@REGISTRY.add("f13_asked_categories", f"""WITH c AS (SELECT p_partkey, [{', '.join(f"'{x}'" for x in (*ASKED_ROOMS, 'hall', 'office'))}][p_size % 6 + 1] AS room, [{', '.join(f"'{x}'" for x in (*UNASKED_OBJECTS, 'lamp', 'sofa'))}][p_partkey % 13 + 1] AS item FROM part)
SELECT p_partkey, room, item FROM c WHERE room IN ({', '.join(f"'{x}'" for x in ASKED_ROOMS)}) AND item NOT IN ({', '.join(f"'{x}'" for x in UNASKED_OBJECTS)})""")
def f13(spark, sf_dir):
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)
    rows = table(spark, sf_dir, "part").select("p_partkey", pick((*ASKED_ROOMS, "hall", "office"), F.col("p_size") % 6).alias("room"), pick((*UNASKED_OBJECTS, "lamp", "sofa"), F.col("p_partkey") % 13).alias("item"))
    return rows.where(asked_categories(F.col("room"), F.col("item")))


@REGISTRY.add("p11_box_centres", f"WITH {POINTS} SELECT frame_id, round((min(x) + max(x)) / 2, 9) AS cx, round((min(z) + max(z)) / 2, 9) AS cz, round(max(x) - min(x), 9) AS dx, round(max(z) - min(z), 9) AS dz FROM points GROUP BY frame_id")
def p11(spark, sf_dir):
    b = spatial.bounds(points(spark, sf_dir), ("frame_id",))
    (cx, _, cz), (dx, _, dz) = G.box_centre(F.struct(*[f"{a}{i}" for a in "xyz" for i in (0, 1)]))
    return b.select("frame_id", *[F.round(c, 9).alias(n) for c, n in ((cx, "cx"), (cz, "cz"), (dx, "dx"), (dz, "dz"))])


@REGISTRY.add("p10_box_corners", "SELECT p_partkey, round(p_size + i * 1.5, 6) AS x, round(p_partkey % 11 + j * 1.0, 6) AS y, round(p_retailprice / 20 + k * 0.5, 6) AS z FROM part, (VALUES (-1), (1)) a(i), (VALUES (-1), (1)) b(j), (VALUES (-1), (1)) c(k)")
def p10(spark, sf_dir):
    corners = G.box_corners(F.col("p_size").cast("double"), (F.col("p_partkey") % 11).cast("double"), F.col("p_retailprice") / 20, F.lit(3.0), F.lit(2.0), F.lit(1.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(corners)).select("p_partkey", *[F.round(c, 6).alias(c) for c in "xyz"])


@REGISTRY.add("p12_grown_boxes", "SELECT p_partkey, greatest(0, p_size - 5) AS x, greatest(0, p_partkey % 11 - 5) AS y, p_size + 12 + 5 - greatest(0, p_size - 5) AS w, p_partkey % 11 + 8 + 5 - greatest(0, p_partkey % 11 - 5) AS h FROM part")
def p12(spark, sf_dir):
    x, y, w, h = G.grow_bbox(F.col("p_size").cast("long"), F.col("p_partkey") % 11, F.lit(12), F.lit(8), 5)
    return table(spark, sf_dir, "part").select("p_partkey", *[c.cast("long").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))])


@REGISTRY.add("p7_grid_to_world", f"WITH {POINTS}, low AS (SELECT min(x) AS lx, min(z) AS lz FROM points), c AS (SELECT DISTINCT CAST(floor(x / 4) AS BIGINT) AS row, CAST(floor(z / 4) AS BIGINT) AS col FROM points) SELECT row, col, round((row - 10.5) * 4 + lx, 6) AS x, round((col - 10.5) * 4 + lz, 6) AS z FROM c, low")
def p7(spark, sf_dir):
    p = points(spark, sf_dir)
    low = p.agg(F.min("x").alias("lx"), F.min("z").alias("lz"))
    cells = raster.occupied(p, 4.0).select("row", "col").join(low)
    return cells.select("row", "col", F.round(G.grid_to_world(F.col("row"), F.col("lx"), 4.0, 10.5), 6).alias("x"), F.round(G.grid_to_world(F.col("col"), F.col("lz"), 4.0, 10.5), 6).alias("z"))


@REGISTRY.add("j9_order_box_iou", f"""WITH {POINTS}, b AS (SELECT frame_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM points GROUP BY frame_id), n AS (SELECT a.frame_id, greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) * greatest(0.0, least(a.z1, b.z1) - greatest(a.z0, b.z0)) AS i,
(a.x1 - a.x0) * (a.y1 - a.y0) * (a.z1 - a.z0) + (b.x1 - b.x0) * (b.y1 - b.y0) * (b.z1 - b.z0) AS s FROM b a JOIN b ON b.frame_id = a.frame_id + 1) SELECT frame_id, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0.0 END, 6) AS iou FROM n""")
def j9(spark, sf_dir):
    boxes = spatial.bounds(points(spark, sf_dir), ("frame_id",)).drop("n_points")
    box = F.struct(*[c for c in boxes.columns if c != "frame_id"])
    one = boxes.select("frame_id", box.alias("a"))
    return one.join(boxes.select((F.col("frame_id") - 1).alias("frame_id"), box.alias("b")), "frame_id").select("frame_id", F.round(G.box_iou("a", "b"), 6).alias("iou"))


_MAP = "map AS (SELECT p_partkey AS map_id, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 11 AS DOUBLE) AS y, p_retailprice / 20 AS z FROM part)"
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


def _map(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 11).cast("double").alias("y"), (F.col("p_retailprice") / 20).alias("z"))


@REGISTRY.add("j2_pixels_fused_into_map", f"""WITH {_MAP}, px AS (SELECT c_custkey AS pixel_id, c_nationkey AS frame_id, c_acctbal / 200 AS x, CAST(c_nationkey % 11 AS DOUBLE) AS y, CAST(c_custkey % 100 AS DOUBLE) AS z FROM customer),
n AS (SELECT pixel_id, frame_id, a.y AS f0, a.z AS f1, arg_min(b.map_id, ({_D2}, b.map_id)) AS point_id FROM px a, map b GROUP BY pixel_id, frame_id, a.y, a.z), l AS (SELECT *, row_number() OVER (PARTITION BY point_id, frame_id ORDER BY pixel_id DESC) AS rank FROM n)
SELECT point_id, count(*) AS frames, round(avg(f0), 9) AS f0, round(avg(f1), 9) AS f1 FROM l WHERE rank = 1 GROUP BY point_id""")
def j2(spark, sf_dir):
    y, z = (F.col("c_nationkey") % 11).cast("double"), (F.col("c_custkey") % 100).cast("double")
    px = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pixel_id"), F.col("c_nationkey").alias("frame_id"), (F.col("c_acctbal") / 200).alias("x"), y.alias("y"), z.alias("z"), F.array(y, z).alias("embedding"))
    fused = scene.fuse_pixels(px, _map(spark, sf_dir), 4.0)
    return fused.select("point_id", "frames", F.round(F.col("mean_vector")[0], 9).alias("f0"), F.round(F.col("mean_vector")[1], 9).alias("f1"))


@REGISTRY.add("j4_room_points", f"""WITH {_MAP}, cells AS (SELECT DISTINCT CAST(p_size % 6 AS BIGINT) AS room_id, CAST(floor(p_size / 5) * 5 AS DOUBLE) AS x, CAST(floor(p_retailprice / 100) * 5 AS DOUBLE) AS z FROM part), up AS (SELECT room_id, x, level * 2.0 AS y, z FROM cells, range(0, 6) t(level))
SELECT DISTINCT room_id, map_id AS point_id FROM up a JOIN map b ON {_D2} <= 4.0""")
def j4(spark, sf_dir):
    cells = table(spark, sf_dir, "part").select((F.col("p_size") % 6).cast("long").alias("room_id"), (F.floor(F.col("p_size") / 5) * 5).cast("double").alias("x"), (F.floor(F.col("p_retailprice") / 100) * 5).cast("double").alias("z")).distinct()
    return scene.room_points(cells, _map(spark, sf_dir), F.lit(0.0), F.lit(10.0), 2.0, 2.0)


@REGISTRY.add("f8_floor_poses", f"WITH {POSES} SELECT frame_id, CAST(r_regionkey AS BIGINT) AS floor_id FROM poses JOIN region ON y - 1.5 >= 15.0 * r_regionkey AND y - 1.5 < 15.0 * (r_regionkey + 1)")
def f8(spark, sf_dir):
    k = F.col("r_regionkey").cast("long")
    floors = table(spark, sf_dir, "region").select(F.lit(0).alias("scene"), k.alias("floor_id"), (15.0 * k).alias("low"), (15.0 * (k + 1)).alias("high"))
    return navigation.floor_poses(poses(spark, sf_dir).withColumn("scene", F.lit(0)), floors).select("frame_id", "floor_id")


_ASK = "ask AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey // 2 AS VARCHAR) ELSE 'upper floor' END AS query, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(n_regionkey AS BIGINT) END AS floor_id, CAST(embedding AS DOUBLE[]) AS q FROM nation JOIN embeddings ON vec_id = n_nationkey)"


def _ask(spark, sf_dir):
    """A question a nation: a number or a text, on a floor or anywhere, with an embedding."""
    k = F.col("n_nationkey").cast("long")
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "embeddings"), F.col("vec_id") == k)
    text = F.when(k % 2 == 0, F.floor(k / 2).cast("string")).otherwise("upper floor")
    return nation.select(k.alias("query_id"), text.alias("query"), F.when(k % 3 != 0, F.col("n_regionkey").cast("long")).alias("floor_id"), as_doubles("embedding").alias("prompt"))


@REGISTRY.add("q1_query_floor", f"""WITH {_ASK}, f AS (SELECT CAST(r_regionkey AS BIGINT) AS floor_id, row_number() OVER (ORDER BY r_regionkey DESC) AS floor_no, CAST(embedding AS DOUBLE[]) AS e FROM region JOIN embeddings ON vec_id = r_regionkey + 50), s AS (SELECT query_id, f.floor_id, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q, e) DESC, floor_no) AS rank FROM ask, f WHERE query = 'upper floor')
SELECT query_id, f.floor_id FROM ask JOIN f ON query = CAST(floor_no AS VARCHAR) UNION ALL SELECT query_id, floor_id FROM s WHERE rank = 1""")
def q1(spark, sf_dir):
    k = F.col("r_regionkey").cast("long")
    floors = table(spark, sf_dir, "region").join(table(spark, sf_dir, "embeddings"), F.col("vec_id") == k + 50).select(k.alias("floor_id"), (-k).alias("level"), as_doubles("embedding").alias("prompt"))
    return search.query_floor(_ask(spark, sf_dir), floors.join(search.floor_ranks(floors), "floor_id"))


_MET = f"{_ASK}, {OBJECTS}, met AS (SELECT query_id, room_id, vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), q) AS sim FROM ask JOIN objects ON ask.floor_id IS NULL OR ask.floor_id = objects.floor_id)"


def _rooms_found(how: str) -> str:
    return f"WITH {_MET}, b AS (SELECT query_id, room_id, {how}(sim) AS sim FROM met GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, room_id) AS rank, max(sim) OVER (PARTITION BY query_id) AS top FROM b) SELECT query_id, CAST(rank AS INTEGER) AS rank, room_id, round(sim, 6) AS sim FROM r WHERE "


def _found(df):
    return df.select("query_id", "rank", "room_id", F.round("sim", 6).alias("sim"))


@REGISTRY.add("q2_rooms_by_views", _rooms_found("max") + "rank <= 3")
def q2_views(spark, sf_dir):
    return _found(search.query_room(_ask(spark, sf_dir), objects(spark, sf_dir).select("room_id", "floor_id", "embedding")))


@REGISTRY.add("q2_rooms_by_children", _rooms_found("avg") + "rank <= 3")
def q2_children(spark, sf_dir):
    return _found(search.query_room(_ask(spark, sf_dir), objects(spark, sf_dir).select("room_id", "floor_id", "embedding"), "children_embedding"))


@REGISTRY.add("q2_rooms_by_label", _rooms_found("max") + "top - sim < 0.05")
def q2_label(spark, sf_dir):
    return _found(search.query_room(_ask(spark, sf_dir), objects(spark, sf_dir).select("room_id", "floor_id", "embedding"), "label", margin=0.05))


_Q5 = f"""WITH {_ASK}, {OBJECTS}, s AS (SELECT query_id, vec_id AS object_id, room_id, room_name, list_dot_product(CAST(embedding AS DOUBLE[]), q) AS sim FROM ask, objects), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, object_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, object_id, room_id, room_name, round(sim, 6) AS sim FROM r WHERE rank <= 5"""


@REGISTRY.add("q5_query_graph", _Q5)
def q5(spark, sf_dir):
    things = objects(spark, sf_dir)
    found = search.query_graph(_ask(spark, sf_dir).select("query_id", "prompt"), things.select(F.col("vec_id").alias("object_id"), "room_id", "embedding"), things.select("room_id", "room_name").distinct())
    return found.select("query_id", "rank", "object_id", "room_id", "room_name", F.round("sim", 6).alias("sim"))


@REGISTRY.add("q5_query_graph_by_cells", _Q5)
def q5_cells(spark, sf_dir):
    things = objects(spark, sf_dir).withColumnRenamed("vec_id", "object_id")
    index = cells.build(things, "object_id", cells=32)
    found = search.query_graph(_ask(spark, sf_dir).select("query_id", "prompt"), things, things.select("room_id", "room_name").distinct(), index=index)
    return found.select("query_id", "rank", "object_id", "room_id", "room_name", F.round("sim", 6).alias("sim"))


@REGISTRY.add("q7_room_names_by_labels", f"""WITH {OBJECTS}, n AS (SELECT room_id, CASE label WHEN 0 THEN 'wall' WHEN 1 THEN 'Floor lamp' ELSE 'class ' || label END AS name FROM objects), c AS (SELECT room_id, name, row_number() OVER (PARTITION BY room_id ORDER BY count(*) DESC, name) AS rank FROM n WHERE NOT regexp_matches(lower(name), 'wall|floor|ceiling|railing|roof|void|unlabeled|misc') GROUP BY 1, 2) SELECT room_id, name FROM c WHERE rank = 1""")
def q7_labels(spark, sf_dir):
    label = F.col("label")
    name = F.when(label == 0, "wall").when(label == 1, "Floor lamp").otherwise(F.concat(F.lit("class "), label.cast("string")))
    return search.name_rooms_by_objects(objects(spark, sf_dir).select("room_id", name.alias("name")))


@REGISTRY.add("q7_room_names_by_embeddings", f"""WITH {OBJECTS}, {PROTOTYPES}, v AS (SELECT room_id, list(m ORDER BY pos) AS embedding FROM (SELECT room_id, pos, avg(v) AS m FROM (SELECT room_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM objects) GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT room_id, class, row_number() OVER (PARTITION BY room_id ORDER BY {_SIM} DESC, class) AS rank FROM v, protos) SELECT room_id, 'class ' || class AS name FROM r WHERE rank = 1""")
def q7_embeddings(spark, sf_dir):
    words = prototypes(spark, sf_dir).select("class", F.concat(F.lit("class "), F.col("class").cast("string")).alias("name"), F.col("query").alias("prompt"))
    return search.name_rooms_by_objects(objects(spark, sf_dir).select("room_id", "embedding"), words)


@REGISTRY.add("q10_valid_answers", f"WITH {OBJECTS} SELECT vec_id AS object_id, min(vec_id) OVER w AS answer_set, count(*) OVER w AS answers FROM objects WINDOW w AS (PARTITION BY room_name, label)")
def q10(spark, sf_dir):
    return search.valid_answers(objects(spark, sf_dir).select(F.col("vec_id").alias("object_id"), F.col("room_name").alias("room_category"), F.col("label").alias("object_category")))


@REGISTRY.add("u11_similar_categories", "SELECT c_custkey, lower(n.n_name) AS name, s.n_name AS similar FROM customer JOIN nation n ON n.n_nationkey = c_nationkey LEFT JOIN nation s ON s.n_regionkey = n.n_regionkey AND s.n_nationkey <> n.n_nationkey")
def u11(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    same = (F.col("n.n_regionkey") == F.col("s.n_regionkey")) & (F.col("n.n_nationkey") != F.col("s.n_nationkey"))
    pairs = nation.alias("n").join(nation.alias("s"), same).select(F.col("n.n_name").alias("category"), F.col("s.n_name").alias("similar"))
    named = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.lower("n_name").alias("name"))
    return search.similar_categories(named, pairs)


@REGISTRY.add("g14_stairs_objects", f"""WITH {OBJECTS}, {PROTOTYPES}, r AS (SELECT vec_id, label, class, row_number() OVER (PARTITION BY vec_id ORDER BY {_SIM} DESC, class) AS rank FROM objects, protos) SELECT vec_id AS object_id FROM r WHERE rank = 1 AND (class = 3 OR label = 7)""")
def g14(spark, sf_dir):
    words = prototypes(spark, sf_dir).select("class", F.when(F.col("class") == 3, "stairs").otherwise("other").alias("name"), F.col("query").alias("prompt"))
    things = objects(spark, sf_dir).select(F.col("vec_id").alias("object_id"), F.when(F.col("label") == 7, "staircase").otherwise("thing").alias("name"), "embedding")
    return navigation.stairs_objects(things, words).select("object_id")


def _walks(spark, sf_dir):
    """Each user's walk up and down five levels, a pose an event."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    level = F.floor(F.col("value") / 40)
    return e.select(F.col("user_id").alias("scene"), F.col("event_id").alias("frame_id"), (F.col("event_id") % 97).cast("double").alias("x"), (level * 3 + F.col("value") % 1 + 1.5).alias("y"), (F.col("event_id") % 89).cast("double").alias("z"))


@REGISTRY.add("g16_stairs_edges")
def g16(spark, sf_dir):
    floors = _walks(spark, sf_dir).select("scene").distinct().crossJoin(spark.range(3).select(F.col("id").cast("int").alias("floor_no"), F.col("id").alias("floor_id"), (3.0 * F.col("id")).alias("zero_level")))
    _, edges = navigation.stairs_graph(_walks(spark, sf_dir), floors)
    return edges.select("scene", "floor_id", "src", "dst", F.round("dist", 6).alias("dist"))


def _floor_cells(spark, sf_dir):
    """Floors are five bands of parts: cells of a wide region, of obstacles in it, and of poses."""
    cells = table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("floor_id"), F.col("p_size").cast("long").alias("row"), F.floor(F.col("p_retailprice") / 40).cast("long").alias("col"), "p_partkey")
    region = raster.close(cells.select("floor_id", "row", "col").distinct(), 2, ("floor_id",))
    return region, cells.where("p_partkey % 7 = 0").select("floor_id", "row", "col").distinct(), cells.where("p_partkey % 3 = 1").select("floor_id", "row", "col").distinct()


@REGISTRY.add("g17_free_map")
def g17(spark, sf_dir):
    region, obstacles, seen = _floor_cells(spark, sf_dir)
    return raster.free_cells(region, seen, obstacles, 1, ("floor_id",))


@REGISTRY.add("g18_floor_graph")
def g18(spark, sf_dir):
    region, obstacles, seen = _floor_cells(spark, sf_dir)
    return navigation.floor_graph(region, seen, obstacles, 1, 2.0, 4.0, ("floor_id",))[1].select("src", "dst", F.round("dist", 6).alias("dist"))


def _walk_graph(spark, sf_dir, half: int):
    """The walks of users of even or odd id as one graph: poses and steps."""
    p = poses(spark, sf_dir).where(F.col("user_id") % 2 == half)
    return p.select(F.col("frame_id").alias("id"), "x", "y", "z"), ordered.step_edges(p, ("ts", "frame_id"), keys=("user_id",)).select("src", "dst", "dist")


@REGISTRY.add("g13_connected_graphs", f"""WITH {POSES}, e AS (SELECT user_id, lag(frame_id) OVER w AS src, frame_id AS dst, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)) AS dist FROM poses WINDOW w AS (PARTITION BY user_id ORDER BY ts, frame_id)),
ends AS (SELECT id FROM (SELECT src AS id FROM e WHERE src IS NOT NULL UNION ALL SELECT dst FROM e WHERE src IS NOT NULL) GROUP BY id HAVING count(*) > 1), o AS (SELECT * FROM poses WHERE user_id % 2 = 1 AND frame_id IN (SELECT id FROM ends)),
l AS (SELECT a.frame_id AS src, b.frame_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist FROM poses a JOIN o b ON a.x >= b.x - 3 AND a.x <= b.x + 3 AND a.z >= b.z - 3 AND a.z <= b.z + 3 AND a.user_id % 2 = 0)
SELECT src, dst, round(dist, 6) AS dist FROM e WHERE src IS NOT NULL UNION ALL (SELECT src, dst, round(dist, 6) FROM l ORDER BY dist, src, dst LIMIT 1)""")
def g13(spark, sf_dir):
    _, edges = navigation.connect(*_walk_graph(spark, sf_dir, 0), *_walk_graph(spark, sf_dir, 1), 1.0)
    return edges.select("src", "dst", F.round("dist", 6).alias("dist"))


@REGISTRY.add("g21_scene_graph", f"""WITH {OBJECTS} SELECT 'building' AS src, CAST(floor_id AS VARCHAR) AS dst FROM objects UNION SELECT CAST(floor_id AS VARCHAR), floor_id || '_' || room_id FROM objects UNION SELECT floor_id || '_' || room_id, floor_id || '_' || room_id || '_' || vec_id FROM objects""")
def g21(spark, sf_dir):
    floor, room = F.col("floor_id").cast("string"), F.concat_ws("_", "floor_id", "room_id")
    o = objects(spark, sf_dir).select(floor.alias("floor_id"), room.alias("room_id"), F.concat_ws("_", "floor_id", "room_id", "vec_id").alias("object_id"), F.col("label").cast("string").alias("name"), "room_name")
    floors, rooms = o.select("floor_id", F.col("floor_id").alias("name")).distinct(), o.select("room_id", "floor_id", F.col("room_name").alias("name")).distinct()
    return graph.assemble(floors, rooms, o.select("object_id", "room_id", "name"))[1]


def _framed(spark, sf_dir):
    """Twelve frames of each scene (a supplier), a segment in each for every block of space."""
    p = points(spark, sf_dir)
    owner, frame = scene_of(10000), F.col("frame_id") % 12
    block = F.floor(F.col("x") / 25).cast("long") * 8 + F.floor(F.col("z") / 60).cast("long")
    return p.select(owner.alias("scene"), frame.alias("frame"), ((owner * 12 + frame) * 64 + block).alias("segment"), "point_id", "x", "y", "z")


@REGISTRY.add("g5_hierarchical_merge")
def g5(spark, sf_dir):
    merged = clustering.hierarchical_merge(_framed(spark, sf_dir), "frame", "segment", "point_id", 0.6, 0.1, 0.3, 4.0, 1.0, 0.75, ("scene",))
    return merged.groupBy("scene", "segment").agg(F.count("*").alias("n_points"))


@REGISTRY.add("g6_sequential_merge")
def g6(spark, sf_dir):
    merged = clustering.sequential_merge(cut(_framed(spark, sf_dir).withColumn("frame", F.col("frame") % 3)), "frame", "segment", "point_id", 0.3, 0.5, 4.0, 1.0, ("scene",))
    return merged.groupBy("scene", "segment").agg(F.count("*").alias("n_points"))


@REGISTRY.add("g8_same_name_objects")
def g8(spark, sf_dir):
    p = _framed(spark, sf_dir)
    names = p.select("segment", F.col("scene").alias("room_id"), (F.col("segment") % 64 % 5).cast("string").alias("name")).distinct()
    return clustering.merge_same_name(p, names, "segment", "point_id", 1.0, 0.2, 32.0)


@REGISTRY.add("p3_turned_clouds", f"WITH {POINTS} SELECT point_id, round(x, 9) AS x, round(z, 9) AS y, round(-y, 9) AS z FROM points")
def p3(spark, sf_dir):
    x, y, z = G.swap_flip(F.col("x"), F.col("y"), F.col("z"))
    return points(spark, sf_dir).select("point_id", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), F.round(z, 9).alias("z"))


@REGISTRY.add("p4_top_down", f"WITH {POINTS} SELECT DISTINCT segment, x, z FROM points")
def p4(spark, sf_dir):
    return raster.top_down(points(spark, sf_dir), ("segment",))


_NEAR = f"""{POINTS}, around AS (SELECT *, floor(x) + i AS cx, floor(y) + j AS cy, floor(z) + k AS cz FROM points, range(-1, 2) t(i), range(-1, 2) u(j), range(-1, 2) v(k)),
h AS (SELECT a.segment AS a, b.segment AS b, a.point_id AS pa, b.point_id AS pb FROM around a JOIN points b ON a.cx = floor(b.x) AND a.cy = floor(b.y) AND a.cz = floor(b.z) AND a.segment < b.segment AND {_D2} < 1.0),
m AS (SELECT a, b, count(DISTINCT pa) AS na, count(DISTINCT pb) AS nb FROM h GROUP BY a, b), s AS (SELECT segment, count(*) AS n FROM points GROUP BY segment)"""


def _overlaps(spark, sf_dir, how):
    p = points(spark, sf_dir)
    ids = p.select("segment").distinct()
    pairs = ids.select(F.col("segment").alias("a")).join(ids.select(F.col("segment").alias("b")), F.col("a") < F.col("b"))
    return spatial.overlap_ratio(p, pairs, "segment", "point_id", 1.0, how).select("a", "b", F.round("overlap", 6).alias("overlap"))


@REGISTRY.add("j5_one_sided_overlap", f"WITH {_NEAR} SELECT a.segment AS a, b.segment AS b, round(coalesce(na, 0) / b.n, 6) AS overlap FROM s a JOIN s b ON a.segment < b.segment LEFT JOIN m ON m.a = a.segment AND m.b = b.segment")
def j5(spark, sf_dir):
    return _overlaps(spark, sf_dir, "one_sided")


@REGISTRY.add("j7_symmetric_overlap", f"WITH {_NEAR} SELECT a.segment AS a, b.segment AS b, round((coalesce(na, 0) + coalesce(nb, 0)) / (a.n + b.n), 6) AS overlap FROM s a JOIN s b ON a.segment < b.segment LEFT JOIN m ON m.a = a.segment AND m.b = b.segment")
def j7(spark, sf_dir):
    return _overlaps(spark, sf_dir, "sum")


_CUSTOMERS = "px AS (SELECT c_custkey, c_acctbal / 200 AS x, CAST(c_nationkey % 11 AS DOUBLE) AS y, CAST(c_custkey % 100 AS DOUBLE) AS z FROM customer)"


@REGISTRY.add("j19_label_transfer", f"WITH {_MAP}, {_CUSTOMERS}, n AS (SELECT c_custkey, arg_min(b.map_id, ({_D2}, b.map_id)) AS map_id, min({_D2}) AS d2 FROM px a, map b GROUP BY c_custkey) SELECT c_custkey, CASE WHEN d2 <= 400 THEN p_brand END AS p_brand, CASE WHEN d2 <= 400 THEN p_size END AS p_size FROM n JOIN part ON p_partkey = map_id")
def j19(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 200).alias("x"), (F.col("c_nationkey") % 11).cast("double").alias("y"), (F.col("c_custkey") % 100).cast("double").alias("z"))
    right = _map(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), "p_brand", "p_size"), "point_id")
    return spatial.transfer_labels(left, right, "c_custkey", "point_id", ("p_brand", "p_size"), 4.0, within=20.0)


@REGISTRY.add("j3_mask_point_features", f"WITH {_MAP}, {_CUSTOMERS}, n AS (SELECT c_custkey, arg_min(b.map_id, ({_D2}, b.map_id)) AS map_id FROM px a, map b GROUP BY c_custkey) SELECT c_nationkey AS segment, c_custkey AS mask_point, map_id AS point_id, round(CAST(embedding[1] AS DOUBLE), 6) AS e0 FROM n JOIN customer USING (c_custkey) JOIN embeddings ON vec_id = map_id")
def j3(spark, sf_dir):
    masked = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("segment"), F.col("c_custkey").alias("mask_point"), (F.col("c_acctbal") / 200).alias("x"), (F.col("c_nationkey") % 11).cast("double").alias("y"), (F.col("c_custkey") % 100).cast("double").alias("z"))
    features = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding")
    found = scene.gather_mask_features(masked, _map(spark, sf_dir), features, 4.0)
    return found.select("segment", "mask_point", "point_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("e0"))


_HEIGHTS = f"{POINTS}, c AS (SELECT segment, CAST(floor(x / 2) AS BIGINT) AS row, CAST(floor(z / 2) AS BIGINT) AS col, max(y) AS height FROM points GROUP BY 1, 2, 3), p AS (SELECT a.segment, a.row, a.col, b.height, exp(-((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) / 2.0) AS w FROM c a JOIN c b ON a.segment = b.segment AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1)"


@REGISTRY.add("w9_gaussian_blur", f"WITH {_HEIGHTS} SELECT segment, row, col, round(sum(w * height) / sum(w), 6) AS height FROM p GROUP BY 1, 2, 3")
def w9_gaussian(spark, sf_dir):
    cells = raster.occupied(points(spark, sf_dir), 2.0, ("segment",))
    return raster.weighted_mean(cells, 1, 1.0, "height", ("segment",)).select("segment", "row", "col", F.round("height", 6).alias("height"))


@REGISTRY.add("w9_median", f"WITH {_HEIGHTS} SELECT segment, row, col, round(median(height), 6) AS height FROM p GROUP BY 1, 2, 3")
def w9_median(spark, sf_dir):
    cells = raster.occupied(points(spark, sf_dir), 2.0, ("segment",))
    return raster.median(cells, 1, "height", ("segment",)).select("segment", "row", "col", F.round("height", 6).alias("height"))


@REGISTRY.add("t9_second_component")
def t9_second(spark, sf_dir):
    return raster.ranked_component(raster.occupied(points(spark, sf_dir), 2.0, ("segment",)).select("segment", "row", "col"), 2, ("segment",))


_REGION = f"{POINTS}, r AS (SELECT DISTINCT segment, CAST(floor(x / 4) AS BIGINT) AS row, CAST(floor(z / 8) * 2 AS BIGINT) AS col FROM points), band AS (SELECT DISTINCT segment, row + i AS row, col + j AS col FROM r, range(-2, 3) a(i), range(-2, 3) b(j))"


@REGISTRY.add("g19_signed_distances", f"""WITH {_REGION}, o AS (SELECT * FROM band ANTI JOIN r USING (segment, row, col)),
i AS (SELECT a.segment, a.row, a.col, min((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) AS d2 FROM r a JOIN o b ON a.segment = b.segment GROUP BY 1, 2, 3), e AS (SELECT a.segment, a.row, a.col, min((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) AS d2 FROM o a JOIN r b ON a.segment = b.segment GROUP BY 1, 2, 3)
SELECT segment, row, col, round(sqrt(d2), 6) AS distance FROM i UNION ALL SELECT segment, row, col, round(-sqrt(d2), 6) FROM e""")
def g19(spark, sf_dir):
    cells = points(spark, sf_dir).select("segment", F.floor(F.col("x") / 4).cast("long").alias("row"), (F.floor(F.col("z") / 8) * 2).cast("long").alias("col")).distinct()
    return raster.signed_distance(cells, 2, ("segment",)).select("segment", "row", "col", F.round("distance", 6).alias("distance"))


@REGISTRY.add("g15_stairs_object_graph")
def g15(spark, sf_dir):
    stairs = points(spark, sf_dir).select((F.col("segment") % 4).alias("scene"), "x", "y", "z")
    _, edges = navigation.stairs_object_graph(stairs, 1.0, 2, 1, 2.0)
    return edges.select("src", "dst", F.round("dist", 6).alias("dist"))


@REGISTRY.add("s18_asked_tree", f"""WITH c AS (SELECT p_size % 3 || '_' || p_size AS room_id, p_size % 3 || '_' || p_size || '_' || p_partkey AS object_id, [{', '.join(f"'{x}'" for x in (*ASKED_ROOMS, 'hall', 'office'))}][p_size % 6 + 1] AS room, [{', '.join(f"'{x}'" for x in (*UNASKED_OBJECTS, 'lamp', 'sofa'))}][p_partkey % 13 + 1] AS item FROM part),
k AS (SELECT DISTINCT room_id FROM c WHERE room IN ({', '.join(f"'{x}'" for x in ASKED_ROOMS)})) SELECT 'building' AS src, split_part(room_id, '_', 1) AS dst FROM c UNION SELECT split_part(room_id, '_', 1), room_id FROM k UNION SELECT room_id, object_id FROM c SEMI JOIN k USING (room_id) WHERE item NOT IN ({', '.join(f"'{x}'" for x in UNASKED_OBJECTS)})""")
def s18(spark, sf_dir):
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)
    size = F.col("p_size")
    room = F.concat_ws("_", (size % 3).cast("string"), size.cast("string"))
    part = table(spark, sf_dir, "part")
    regions = part.select(room.alias("room_id"), pick((*ASKED_ROOMS, "hall", "office"), size % 6).alias("category")).distinct()
    things = part.select(F.concat_ws("_", room, F.col("p_partkey").cast("string")).alias("object_id"), pick((*UNASKED_OBJECTS, "lamp", "sofa"), F.col("p_partkey") % 13).alias("category"))
    return scene.asked_tree(regions, things)[1]
