"""Hierarchical queries, scene hierarchy and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phrases as P
from ..operators import spatial
from ..plans import scene, search
from .tables import OBJECTS, POINTS, POSES, PROTOTYPES, Registry, objects, points, poses, prototypes, table

REGISTRY = Registry()
_SIM = "list_dot_product(CAST(embedding AS DOUBLE[]), query)"


def _phrases(spark, sf_dir):
    """A query for each room: "class 3 in the france on floor 4"."""
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("class "), (F.col("n_nationkey") % 10).cast("string"), F.lit(" in the "), F.lower("n_name"), F.lit(" on floor "), (F.col("n_regionkey") + 1).cast("string")).alias("query"))


_PHRASES = "q AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, 'class ' || (n_nationkey % 10) || ' in the ' || lower(n_name) || ' on floor ' || (n_regionkey + 1) AS query, n_nationkey % 10 AS class, lower(n_name) AS room_name, n_regionkey + 1 AS floor_no FROM nation)"


@REGISTRY.add("u6_parsed_phrases", f"WITH {_PHRASES} SELECT query_id, query, CAST(floor_no AS INTEGER) AS floor_no, room_name, 'class ' || class AS object_name FROM q")
def u6(spark, sf_dir):
    return search.parse(_phrases(spark, sf_dir))


@REGISTRY.add("q4_hierarchical_search", f"""WITH {_PHRASES}, {OBJECTS}, {PROTOTYPES}, s AS (SELECT query_id, floor_id, room_id, vec_id AS object_id, list_dot_product(CAST(embedding AS DOUBLE[]), p.query) AS sim FROM q JOIN objects o ON o.room_name = q.room_name AND o.floor_id + 1 = q.floor_no JOIN protos p ON p.class = q.class),
n AS (SELECT vec_id AS object_id, max(list_dot_product(CAST(embedding AS DOUBLE[]), query)) AS rival FROM embeddings, protos WHERE class = 9 GROUP BY vec_id), w AS (SELECT s.*, CASE WHEN sim >= rival THEN 1 ELSE 0 END AS wins FROM s JOIN n USING (object_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY wins DESC, sim DESC, object_id) AS rank FROM w) SELECT query_id, CAST(rank AS INTEGER) AS rank, floor_id, room_id, object_id, round(sim, 6) AS sim, wins FROM r WHERE rank <= 5""")
def q4(spark, sf_dir):
    floors = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("floor_id"), F.col("r_regionkey").alias("level"))
    things = objects(spark, sf_dir)
    rooms = things.select("room_id", "floor_id", "room_name").distinct()
    words = prototypes(spark, sf_dir).select(F.concat(F.lit("class "), F.col("class").cast("string")).alias("name"), F.col("query").alias("prompt"))
    found = search.hierarchical(_phrases(spark, sf_dir), search.floor_ranks(floors), rooms, things.select(F.col("vec_id").alias("object_id"), "room_id", "embedding"), words, 5, F.col("name") == "class 9")
    return found.withColumn("sim", F.round("sim", 6))


@REGISTRY.add("q7_room_names", f"""WITH {OBJECTS}, {PROTOTYPES}, v AS (SELECT room_id, vec_id, class, row_number() OVER (PARTITION BY vec_id ORDER BY {_SIM} DESC, class) AS rank FROM objects, protos),
c AS (SELECT room_id, class, count(*) AS votes FROM v WHERE rank = 1 GROUP BY room_id, class), r AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY votes DESC, class) AS rank FROM c) SELECT room_id, 'class ' || class AS name FROM r WHERE rank = 1""")
def q7(spark, sf_dir):
    words = prototypes(spark, sf_dir).select("class", F.concat(F.lit("class "), F.col("class").cast("string")).alias("name"), F.col("query").alias("prompt"))
    return search.name_rooms(objects(spark, sf_dir).select("room_id", F.col("vec_id").alias("view_id"), "embedding"), words)


@REGISTRY.add("q9_long_queries", f"""WITH {OBJECTS}, o AS (SELECT vec_id, 'class ' || label AS name, room_name, floor_id + 1 AS floor_no FROM objects),
f AS (SELECT vec_id, unnest([name, name || ' in the ' || room_name, name || ' on floor ' || floor_no, name || ' in the ' || room_name || ' on floor ' || floor_no]) AS query FROM o) SELECT query, count(*) AS answers, min(vec_id) AS first, max(vec_id) AS last FROM f GROUP BY query""")
def q9(spark, sf_dir):
    things = objects(spark, sf_dir).select(F.col("vec_id").alias("object_id"), F.concat(F.lit("class "), F.col("label").cast("string")).alias("object_name"), "room_name", (F.col("floor_id") + 1).alias("floor_no"))
    return search.long_queries(things).groupBy("query").agg(F.count("*").alias("answers"), F.min("object_id").alias("first"), F.max("object_id").alias("last"))


@REGISTRY.add("s19_hierarchy_parents", f"""WITH {OBJECTS}, o AS (SELECT floor_id, room_id, row_number() OVER (PARTITION BY floor_id, room_id ORDER BY vec_id) - 1 AS n, label FROM objects)
SELECT floor_id || '_' || room_id || '_' || n AS object_id, floor_id || '_' || room_id AS parent_id, label FROM o""")
def s19(spark, sf_dir):
    named = scene.hierarchy_ids(objects(spark, sf_dir).withColumnRenamed("vec_id", "object_no"))
    return named.select("object_id", P.parent_id(F.col("object_id")).alias("parent_id"), "label")


@REGISTRY.add("e13_topology", f"""WITH {POINTS}, {OBJECTS}, p AS (SELECT (point_id // 80000) % 100000 // 10 AS vec_id, x, y, z FROM points)
SELECT floor_id, room_id, count(DISTINCT objects.vec_id) AS n_objects, count(x) AS n_points, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy, round(avg(z), 9) AS cz FROM objects LEFT JOIN p ON p.vec_id = objects.vec_id GROUP BY floor_id, room_id""")
def e13(spark, sf_dir):
    # an object's points are those of ten parts; ids beyond 2**53 lose digits as doubles
    p = points(spark, sf_dir).select(F.expr("point_id div 80000 % 100000 div 10").alias("vec_id"), "x", "y", "z")
    sums = p.groupBy("vec_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "xyz"])
    joined = objects(spark, sf_dir).join(sums, "vec_id", "left")
    n = F.sum("n")
    return joined.groupBy("floor_id", "room_id").agg(F.countDistinct("vec_id").alias("n_objects"), F.coalesce(n, F.lit(0)).alias("n_points"), *[F.round(F.sum(c) / n, 9).alias(f"c{c}") for c in "xyz"])


@REGISTRY.add("a18_graph_sizes", f"""WITH {OBJECTS} SELECT 'object' AS type, count(*) AS n FROM objects UNION ALL SELECT 'room', count(DISTINCT room_id) FROM objects UNION ALL SELECT 'floor', count(DISTINCT floor_id) FROM objects""")
def a18(spark, sf_dir):
    o = objects(spark, sf_dir)
    one = lambda kind, n: o.agg(n.alias("n")).select(F.lit(kind).alias("type"), "n")
    return one("object", F.count("*")).unionByName(one("room", F.countDistinct("room_id"))).unionByName(one("floor", F.countDistinct("floor_id")))


@REGISTRY.add("f11_objects_on_floors", f"""WITH {POINTS}, b AS (SELECT frame_id, min(y) AS y0, max(y) AS y1 FROM points GROUP BY frame_id), f AS (SELECT CAST(r_regionkey AS BIGINT) AS floor_id, r_regionkey * 1.0 - 1 AS low, r_regionkey * 2.0 + 4 AS high FROM region)
SELECT frame_id, floor_id FROM b JOIN f ON y0 > low - 0.2 AND y1 < high + 0.2""")
def f11(spark, sf_dir):
    boxes = spatial.bounds(points(spark, sf_dir), ("frame_id",))
    k = F.col("r_regionkey")
    floors = table(spark, sf_dir, "region").select(k.cast("long").alias("floor_id"), (k * 1.0 - 1).alias("low"), (k * 2.0 + 4).alias("high"))
    return scene.objects_on_floors(boxes, floors).select("frame_id", "floor_id")


_ROOMS = "rooms AS (SELECT CAST(p_size % 6 AS BIGINT) AS room_id, p_partkey AS cell_id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 20 AS z FROM part)"


def _room_cells(spark, sf_dir):
    """Rooms as cells: one a part, in six rooms."""
    return table(spark, sf_dir, "part").select((F.col("p_size") % 6).cast("long").alias("room_id"), F.col("p_partkey").alias("cell_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 20).alias("z"))


@REGISTRY.add("j10_object_rooms", f"""WITH {POINTS}, {_ROOMS}, o AS (SELECT segment, point_id, x, z FROM points),
h AS (SELECT segment, room_id, count(DISTINCT cell_id) AS hits FROM o JOIN rooms r ON (o.x - r.x) * (o.x - r.x) + (o.z - r.z) * (o.z - r.z) < 0.25 GROUP BY 1, 2), b AS (SELECT segment, room_id, row_number() OVER (PARTITION BY segment ORDER BY hits DESC, room_id) AS rank FROM h),
c AS (SELECT segment, avg(x) AS cx, avg(z) AS cz FROM o GROUP BY 1), m AS (SELECT room_id, avg(x) AS rx, avg(z) AS rz FROM rooms GROUP BY 1), f AS (SELECT segment, room_id, row_number() OVER (PARTITION BY segment ORDER BY (cx - rx) * (cx - rx) + (cz - rz) * (cz - rz), room_id) AS rank FROM c, m)
SELECT c.segment, coalesce(b.room_id, f.room_id) AS room_id FROM c LEFT JOIN b ON b.segment = c.segment AND b.rank = 1 LEFT JOIN f ON f.segment = c.segment AND f.rank = 1""")
def j10(spark, sf_dir):
    return scene.assign_rooms(points(spark, sf_dir), _room_cells(spark, sf_dir), radius=0.5)


@REGISTRY.add("j12_room_cameras", f"""WITH {POINTS}, {_ROOMS}, {POSES}, m AS (SELECT room_id, avg(x) AS rx, avg(z) AS rz FROM rooms GROUP BY 1), d AS (SELECT frame_id, room_id, (x - rx) * (x - rx) + (z - rz) * (z - rz) AS d2 FROM poses, m WHERE y BETWEEN 10 AND 40),
a AS (SELECT room_id, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY d2, room_id) AS rank FROM d) WHERE rank = 1),
b AS (SELECT room_id, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY d2, frame_id) AS rank FROM d WHERE room_id NOT IN (SELECT room_id FROM a)) WHERE rank = 1) SELECT room_id, frame_id FROM a UNION ALL SELECT room_id, frame_id FROM b""")
def j12(spark, sf_dir):
    return scene.assign_cameras(poses(spark, sf_dir), _room_cells(spark, sf_dir), 10, 40)


@REGISTRY.add("p3_templates", f"WITH t AS (SELECT unnest(['a photo of a %', 'there is a % in the scene']) AS template), {OBJECTS} SELECT DISTINCT replace(template, '%', room_name) AS prompt, room_name FROM objects, t")
def p3(spark, sf_dir):
    templates = spark.createDataFrame([("a photo of a %",), ("there is a % in the scene",)], "template string")
    rooms = objects(spark, sf_dir).select("room_name").distinct()
    return rooms.crossJoin(F.broadcast(templates)).select(F.expr("replace(template, '%', room_name)").alias("prompt"), "room_name")


@REGISTRY.add("a16_query_first_occurrence", "WITH e AS (SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rank FROM events) SELECT event_id, user_id, event_type FROM e WHERE rank = 1")
def a16(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return first.select("event_id", "user_id", "event_type")
