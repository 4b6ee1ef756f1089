"""Similarity search, labels, votes and segmentation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import metrics, ranking
from .tables import OBJECTS, PROTOTYPES, Registry, objects, prototypes, table

REGISTRY = Registry()
_SIM = "list_dot_product(CAST(embedding AS DOUBLE[]), query)"
_FIRST = "first_query AS (SELECT CAST(embedding AS DOUBLE[]) AS query FROM embeddings ORDER BY vec_id LIMIT 1)"


def _first_query(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).select(V.as_doubles("embedding").alias("query"))


def _scored(spark, sf_dir):
    return ranking.score(objects(spark, sf_dir), F.broadcast(prototypes(spark, sf_dir)))


@REGISTRY.add("t1_global_top_objects", f"WITH {_FIRST} SELECT vec_id, round({_SIM}, 6) AS sim FROM embeddings, first_query ORDER BY {_SIM} DESC, vec_id LIMIT 5")
def t1(spark, sf_dir):
    scored = ranking.score(table(spark, sf_dir, "embeddings"), _first_query(spark, sf_dir))
    return ranking.top_k(scored, 5, order=(F.col("vec_id"),)).select("vec_id", F.round("sim", 6).alias("sim"))


@REGISTRY.add("t2_top_rooms", f"WITH {_FIRST}, {OBJECTS} SELECT room_id, round(max({_SIM}), 6) AS sim FROM objects, first_query GROUP BY room_id ORDER BY max({_SIM}) DESC, room_id LIMIT 3")
def t2(spark, sf_dir):
    return ranking.best_group(ranking.score(objects(spark, sf_dir), _first_query(spark, sf_dir)), "room_id", 3).select("room_id", F.round("sim", 6).alias("sim"))


@REGISTRY.add("t3_rooms_near_best", f"WITH {_FIRST}, {OBJECTS}, s AS (SELECT room_id, max({_SIM}) AS sim FROM objects, first_query GROUP BY room_id) SELECT room_id, round(sim, 6) AS sim FROM s WHERE (SELECT max(sim) FROM s) - sim < 0.6")
def t3(spark, sf_dir):
    best = ranking.score(objects(spark, sf_dir), _first_query(spark, sf_dir)).groupBy("room_id").agg(F.max("sim").alias("sim"))
    return ranking.near_best(best, 0.6).select("room_id", F.round("sim", 6).alias("sim"))


@REGISTRY.add("t4_objects_with_negatives", f"""WITH {PROTOTYPES}, s AS (SELECT vec_id, class, {_SIM} AS sim FROM embeddings, protos WHERE class < 4),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, class) AS first FROM s),
w AS (SELECT vec_id, sim FROM r WHERE class = 0 AND first = 1)
SELECT vec_id, round(sim, 6) AS sim FROM w ORDER BY sim DESC, vec_id LIMIT 10""")
def t4(spark, sf_dir):
    prompts = prototypes(spark, sf_dir).where("class < 4")
    scored = ranking.score(table(spark, sf_dir, "embeddings"), F.broadcast(prompts))
    return ranking.top_k_with_negatives(scored, "vec_id", 10, "class", 0).select("vec_id", F.round("sim", 6).alias("sim"))


@REGISTRY.add("t5_top_k_accuracy", f"""WITH {PROTOTYPES}, s AS (SELECT vec_id, label, class, {_SIM} AS sim FROM embeddings, protos),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, class) AS rank FROM s)
SELECT CAST(k AS INTEGER) AS k, round(sum(CASE WHEN class = label AND rank <= k THEN 1 ELSE 0 END) / count(DISTINCT vec_id), 6) AS accuracy FROM r, (VALUES (1), (2), (3), (5), (10)) AS ks(k) GROUP BY k""")
def t5(spark, sf_dir):
    return metrics.top_k_accuracy(_scored(spark, sf_dir), "vec_id", "class", "label", (1, 2, 3, 5, 10)).select("k", F.round("accuracy", 6).alias("accuracy"))


@REGISTRY.add("e4_accuracy_area", f"""WITH {PROTOTYPES}, s AS (SELECT vec_id, label, class, {_SIM} AS sim FROM embeddings, protos),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, class) AS rank FROM s),
c AS (SELECT k / 10.0 AS x, sum(CASE WHEN class = label AND rank <= k THEN 1 ELSE 0 END) / count(DISTINCT vec_id) AS y FROM r, (VALUES (0), (2), (4), (6), (8), (10)) AS ks(k) GROUP BY k),
p AS (SELECT (x - lag(x) OVER (ORDER BY x)) * (y + lag(y) OVER (ORDER BY x)) / 2 AS part FROM c)
SELECT round(sum(part), 6) AS area FROM p""")
def e4(spark, sf_dir):
    curve = metrics.top_k_accuracy(_scored(spark, sf_dir), "vec_id", "class", "label", (0, 2, 4, 6, 8, 10)).withColumn("x", F.col("k") / 10)
    return metrics.area_under(curve, "x", "accuracy").select(F.round("area", 6).alias("area"))


@REGISTRY.add("t8_argmax_label", f"""WITH {PROTOTYPES}, s AS (SELECT vec_id, class, {_SIM} AS sim FROM embeddings, protos), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, class) AS rank FROM s)
SELECT vec_id, class, round(sim, 6) AS sim FROM r WHERE rank = 1""")
def t8(spark, sf_dir):
    return ranking.argmax_label(_scored(spark, sf_dir), ("vec_id",), "class").select("vec_id", "class", F.round("sim", 6).alias("sim"))


@REGISTRY.add("t10_medoids", f"""WITH {PROTOTYPES}, s AS (SELECT label, vec_id, {_SIM} AS sim FROM embeddings JOIN protos ON label = class), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank FROM s)
SELECT label, vec_id, round(sim, 6) AS sim FROM r WHERE rank = 1""")
def t10(spark, sf_dir):
    centres = prototypes(spark, sf_dir).select(F.col("class").alias("label"), F.col("query").alias("mean_vector"))
    return ranking.medoids(table(spark, sf_dir, "embeddings"), centres, "label", "vec_id").select("label", "vec_id", F.round("sim", 6).alias("sim"))


@REGISTRY.add("a3_room_mean_vectors", f"""WITH {OBJECTS}, e AS (SELECT room_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM objects)
SELECT room_id, CAST(pos - 1 AS INTEGER) AS pos, round(avg(v), 6) AS v FROM e GROUP BY room_id, pos""")
def a3(spark, sf_dir):
    means = V.mean_vectors(objects(spark, sf_dir), ["room_id"], "embedding")
    return means.select("room_id", F.posexplode("mean_vector").alias("pos", "v")).select("room_id", "pos", F.round("v", 6).alias("v"))


@REGISTRY.add("a4_blend_vectors", """WITH n AS (SELECT vec_id + 1 AS vec_id, embedding AS other FROM embeddings),
b AS (SELECT e.vec_id, list_transform(range(1, 65), lambda i: 0.4418 * CAST(e.embedding[i] AS DOUBLE) + (1 - 0.4418) * CAST(other[i] AS DOUBLE)) AS v FROM embeddings e JOIN n USING (vec_id))
SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last FROM b""")
def a4(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    other = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    mixed = e.join(other, "vec_id").select("vec_id", V.blend("embedding", "other", 0.4418).alias("v"))
    return mixed.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@REGISTRY.add("a5_softmax_weights", f"""WITH {_FIRST}, {OBJECTS}, s AS (SELECT vec_id, room_id, {_SIM} AS sim FROM objects, first_query)
SELECT vec_id, round(exp(sim - max(sim) OVER w) / (sum(exp(sim)) OVER w / exp(max(sim) OVER w)), 6) AS weight FROM s WINDOW w AS (PARTITION BY room_id)""")
def a5(spark, sf_dir):
    scored = ranking.score(objects(spark, sf_dir), _first_query(spark, sf_dir))
    return scored.select("vec_id", F.round(V.softmax_over("sim", "room_id"), 6).alias("weight"))


@REGISTRY.add("a12_room_label_vote", f"""WITH {OBJECTS}, c AS (SELECT room_id, label, count(*) AS votes FROM objects GROUP BY room_id, label), r AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY votes DESC, label) AS rank FROM c)
SELECT room_id, label, votes FROM r WHERE rank = 1""")
def a12(spark, sf_dir):
    return ranking.majority(objects(spark, sf_dir), ("room_id",), "label")


def _predicted(spark, sf_dir):
    best = ranking.argmax_label(_scored(spark, sf_dir), ("vec_id", "label"), "class")
    return metrics.confusion(best.withColumnRenamed("class", "guess"), "guess", "label")


_CONF = f"""{PROTOTYPES}, s AS (SELECT vec_id, label, class, {_SIM} AS sim FROM embeddings, protos), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, class) AS rank FROM s),
conf AS (SELECT class AS pred, label AS gt, count(*) AS n FROM r WHERE rank = 1 GROUP BY class, label)"""
_PER_CLASS = f"""{_CONF}, t AS (SELECT gt AS class, sum(n) AS t, sum(CASE WHEN pred = gt THEN n ELSE 0 END) AS tp FROM conf GROUP BY gt), p AS (SELECT pred AS class, sum(n) AS p FROM conf GROUP BY pred),
c AS (SELECT coalesce(t.class, p.class) AS class, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(t, 0) AS BIGINT) AS t, CAST(coalesce(p, 0) AS BIGINT) AS p FROM t FULL JOIN p ON t.class = p.class),
i AS (SELECT *, CASE WHEN class = 9 THEN 0.0 ELSE tp / (t + p - tp) END AS iou FROM c)"""


@REGISTRY.add("a17_confusion", f"WITH {_CONF} SELECT pred, gt, n FROM conf")
def a17(spark, sf_dir):
    return _predicted(spark, sf_dir)


@REGISTRY.add("e7_class_iou", f"WITH {_PER_CLASS} SELECT class, tp, t, p, round(iou, 6) AS iou FROM i")
def e7(spark, sf_dir):
    return metrics.per_class(_predicted(spark, sf_dir), (9,)).select("class", "tp", "t", "p", F.round("iou", 6).alias("iou"))


@REGISTRY.add("e5_segmentation_summary", f"""WITH {_PER_CLASS}, k AS (SELECT *, t > 0 AND class <> 9 AS own FROM i)
SELECT round(sum(CASE WHEN own THEN tp ELSE 0 END) / sum(CASE WHEN own THEN t ELSE 0 END), 6) AS pixel_accuracy, round(sum(CASE WHEN own THEN tp / t ELSE 0 END) / sum(CASE WHEN own THEN 1 ELSE 0 END), 6) AS mean_accuracy,
round(sum(iou) / sum(CASE WHEN own THEN 1 ELSE 0 END), 6) AS mean_iou, round(sum(CASE WHEN own THEN t * iou ELSE 0 END) / sum(CASE WHEN own THEN t ELSE 0 END), 6) AS fw_iou FROM k""")
def e5(spark, sf_dir):
    one = metrics.segmentation_summary(_predicted(spark, sf_dir), (9,))
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


@REGISTRY.add("e6_label_confusion", "SELECT CAST(quality AS BIGINT) AS pred, CAST(toxic AS BIGINT) AS gt, count(*) AS n FROM labels GROUP BY quality, toxic")
def e6(spark, sf_dir):
    return metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic").select(F.col("pred").cast("long").alias("pred"), F.col("gt").cast("long").alias("gt"), "n")


@REGISTRY.add("a19_room_rollup", f"WITH {OBJECTS} SELECT floor_id, room_id, count(*) AS n, count(DISTINCT label) AS labels FROM objects GROUP BY ROLLUP (floor_id, room_id)")
def a19(spark, sf_dir):
    return objects(spark, sf_dir).rollup("floor_id", "room_id").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))
