"""Scene documents, tables of a scene graph, and small dimension files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import normalize

_BOX = ", ".join(f"{p}_{c}:array<double>" for p in ("aabb", "obb") for c in ("center", "dims"))
SCENE = (
    "levels array<struct<id:int,lower:double,upper:double,regions:array<int>,objects:array<int>>>, "
    "regions array<struct<id:int,floor_id:int,voted_category:string,category:string,min_height:double,max_height:double,mean_height:double,bev_region_points:array<array<double>>,objects:array<int>>>, "
    f"objects array<struct<id:int,category:string,hex:string,region_id:int,floor_id:int,{_BOX}>>"
)
FLOORS = "floor_id string, name string, rooms array<string>, vertices array<array<double>>, floor_height double, floor_zero_level double"
ROOMS = "room_id string, floor_id string, name string, objects array<string>, vertices array<array<double>>, room_height double, room_zero_level double, embeddings array<array<float>>, represent_images array<int>"
OBJECTS = "object_id string, room_id string, name string, vertices array<array<double>>, embedding array<float>"


def read_scene(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """levels, regions and objects of scene documents, with ids "f", "f_r" and "f_r_o"."""
    doc = spark.read.schema(SCENE).json(path, multiLine=True)
    levels = doc.select(F.inline("levels")).withColumn("floor_id", F.col("id").cast("string"))
    regions = doc.select(F.inline("regions")).withColumn("room_id", F.concat_ws("_", "floor_id", "id"))
    objects = doc.select(F.inline("objects")).withColumn("object_id", F.concat_ws("_", "floor_id", "region_id", "id"))
    return levels, regions, objects


def write_scene(levels: DataFrame, regions: DataFrame, objects: DataFrame, path: str, scene: str = "") -> None:
    """A document of three arrays for each scene; without a scene column, one for all rows, which are then one scene's."""
    by = [scene] if scene else []

    def gather(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*[c for c in df.columns if c not in by])
        return df.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias(name))

    parts = gather(levels, "levels"), gather(regions, "regions"), gather(objects, "objects")
    if by:
        parts[0].join(parts[1], by, "left").join(parts[2], by, "left").write.mode("overwrite").partitionBy(scene).json(path)
    else:
        parts[0].crossJoin(parts[1]).crossJoin(parts[2]).write.mode("overwrite").json(path)


def write_graph(floors: DataFrame, rooms: DataFrame, objects: DataFrame, folder: str) -> None:
    """The hierarchy as Parquet, rooms and objects partitioned by floor so that a floor's search reads its part."""
    floors.write.mode("overwrite").parquet(f"{folder}/floors")
    rooms.withColumn("floor", F.col("floor_id")).write.mode("overwrite").partitionBy("floor").parquet(f"{folder}/rooms")
    objects.withColumn("floor", F.substring_index("object_id", "_", 1)).write.mode("overwrite").partitionBy("floor").parquet(f"{folder}/objects")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{folder}/{t}") for t in ("floors", "rooms", "objects"))


def read_semantic_text(spark: SparkSession, path: str) -> DataFrame:
    """id, hex, category, region of a comma-separated file with a header line; quoted commas stay in their field."""
    return spark.read.text(path).where("not value rlike '^HM3D|^[A-Za-z ]+$'").select(F.from_csv("value", "id int, hex string, category string, region int").alias("r")).select("r.*").where("id is not null")


def read_floor_separation(spark: SparkSession, path: str) -> DataFrame:
    """scene, heights of a CSV whose second column is a quoted list."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"').toDF("scene", "heights")
    return rows.select("scene", F.from_json("heights", "array<double>").alias("heights"))


def read_class_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=";", header=True).toDF("name", "n").select("name", F.col("n").cast("int").alias("n"))


def mesh_vertices(faces: DataFrame, vertices: DataFrame, classes: DataFrame) -> DataFrame:
    """Vertices of labelled faces with class ids: faces face_id, object_id, vertex_indices; an unknown object is class 0."""
    corners = faces.select("face_id", "object_id", F.explode("vertex_indices").alias("vertex_id"))
    return corners.join(vertices, "vertex_id").join(classes, "object_id", "left").withColumn("class_id", F.coalesce("class_id", F.lit(0)))


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """class_id and name of a JSON document {"classes": [{"id": ..., "name": ...}, ...]}."""
    doc = spark.read.schema("classes array<struct<id:int,name:string>>").json(path, multiLine=True)
    return doc.select(F.inline("classes")).select(F.col("id").alias("class_id"), "name")


def read_region_labels(spark: SparkSession, path: str, columns: tuple[str, str, str], scene: str | None = None) -> DataFrame:
    """scene, region_id and category of a CSV with a header; columns: their names there.  With ``scene``, its rows alone."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"')
    names = [F.trim(F.col(f"`{c}`")) for c in columns]
    out = rows.select(names[0].alias("scene"), names[1].try_cast("int").alias("region_id"), names[2].alias("category"))
    return out.where(F.col("scene") == scene) if scene is not None else out


def label_regions(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """regions (scene, region_id) with their category, and labelled = false where the labels have none; of several labels the least counts."""
    one = labels.groupBy("scene", "region_id").agg(F.min("category").alias("category"))
    return regions.join(one, ["scene", "region_id"], "left").withColumn("labelled", F.col("category").isNotNull())


def write_vocabulary(names: DataFrame, features: DataFrame, folder: str) -> None:
    """Label vocabularies with their text embeddings (names: vocabulary, class, name; features: name, prompt), a folder each."""
    names.join(features, "name", "left").write.mode("overwrite").partitionBy("vocabulary").parquet(folder)


def read_vocabulary(spark: SparkSession, folder: str, vocabulary: str) -> DataFrame:
    """class, name and prompt of one vocabulary; an unknown one raises."""
    found = spark.read.parquet(folder).where(F.col("vocabulary") == vocabulary).select("class", "name", "prompt")
    if found.isEmpty():
        raise ValueError(f"there is no vocabulary {vocabulary}")
    return found


def write_cloud(points: DataFrame, features: DataFrame, folder: str) -> None:
    """A map's points (point_id, x, y, z, r, g, b) and their features (point_id, embedding) as Parquet."""
    points.write.mode("overwrite").parquet(f"{folder}/points")
    features.write.mode("overwrite").parquet(f"{folder}/features")


def read_cloud(spark: SparkSession, folder: str, unit: bool = False) -> tuple[DataFrame, DataFrame]:
    """points and features; unit: features of length 1 (a vector of zeros stays)."""
    points, features = spark.read.parquet(f"{folder}/points"), spark.read.parquet(f"{folder}/features")
    return points, features.withColumn("embedding", normalize(F.col("embedding"))) if unit else features


def read_masks(spark: SparkSession, clouds: str, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mask points and features of the masks that have a cloud "pcd_<mask_id>.ply" in a folder; features of missing ones drop out.

    The "ply" data source must be registered (see ply.register).
    """
    points = spark.read.format("ply").load(clouds).withColumn("mask_id", F.regexp_extract("cloud_id", r"^pcd_(\d+)$", 1).try_cast("int")).where("mask_id is not null")
    return points, features.join(points.select("mask_id").distinct(), "mask_id", "left_semi")


def write_room_views(views: DataFrame, folder: str) -> None:
    """room_id, frame_id and embedding of the views that stand for rooms."""
    views.select("room_id", "frame_id", "embedding").write.mode("overwrite").parquet(folder)


def write_navigation(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A navigation graph: nodes (id and columns) and edges (src, dst, dist) as Parquet."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nav_vertices")
    edges.write.mode("overwrite").parquet(f"{folder}/nav_edges")


def read_navigation(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nav_vertices"), spark.read.parquet(f"{folder}/nav_edges")
