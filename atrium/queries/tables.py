"""How the driver's tables stand for the engine's: DataFrames and the same views as SQL.

points: lineitem, in segments by part and frames by order.  objects: embeddings,
in rooms by id.  rooms and floors: nation and region.  poses: events in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_SEGMENTS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, segment, frame_id, x, y, z."""
    return table(spark, sf_dir, "lineitem").select(
        (((F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 8 + F.col("l_linenumber")).alias("point_id"), (F.col("l_partkey") % N_SEGMENTS).alias("segment"), F.col("l_orderkey").alias("frame_id"),
        F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"),
    )


def scene_of(n: int) -> Column:
    """The scene of a point: its supplier by point_id, modulo n; in whole numbers, since ids beyond 2**53 lose digits as doubles."""
    return F.expr("point_id div 8") % n


POINTS = f"points AS (SELECT ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 8 + l_linenumber AS point_id, l_partkey % {N_SEGMENTS} AS segment, l_orderkey AS frame_id, CAST(l_quantity AS DOUBLE) AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z FROM lineitem)"


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding, label, room_id (nation), floor_id (region)."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("room_id"), F.col("n_regionkey").cast("long").alias("floor_id"), F.lower("n_name").alias("room_name"))
    return table(spark, sf_dir, "embeddings").withColumn("room_id", F.col("vec_id") % 25).join(nation, "room_id")


OBJECTS = "objects AS (SELECT vec_id, embedding, label, vec_id % 25 AS room_id, CAST(n_regionkey AS BIGINT) AS floor_id, lower(n_name) AS room_name FROM embeddings JOIN nation ON vec_id % 25 = n_nationkey)"


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class and query (mean embedding) of each label: a vocabulary of ten rows."""
    from ..functions.vector import mean_vectors

    return mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding", "query").select(F.col("label").alias("class"), "query")


PROTOTYPES = "protos AS (SELECT label AS class, list(m ORDER BY pos) AS query FROM (SELECT label, pos, avg(v) AS m FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)"


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, user_id, ts, y (height) and x, z of a walk."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_id"), "user_id", "ts", F.col("value").alias("y"), (F.col("event_id") % 97).cast("double").alias("x"), (F.col("event_id") % 89).cast("double").alias("z"))


POSES = "poses AS (SELECT event_id AS frame_id, user_id, ts, value AS y, CAST(event_id % 97 AS DOUBLE) AS x, CAST(event_id % 89 AS DOUBLE) AS z FROM events)"


class Registry(dict):
    """name -> (function, SQL or None)."""

    def add(self, name: str, sql: str | None = None):
        def put(f):
            self[name] = (f, sql)
            return f

        return put
