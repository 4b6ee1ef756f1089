"""Graph operators on tables of nodes and edges (src, dst, dist)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window as W

from ..session import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once in both directions, without loops."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)).where("src <> dst").dropDuplicates(["src", "dst"])


def components(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """node and component (its least node): least labels of neighbours, with pointer jumping.

    Lineage is cut each round; rounds end when no label falls, as each round lowers one.
    """
    both = cut(undirected(edges.select("src", "dst")))
    labels = cut(nodes.select(F.col(node).alias("id"), F.col(node).alias("component")).distinct())
    while True:
        heard = both.join(labels, both.src == labels.id).groupBy("dst").agg(F.min("component").alias("least"))
        lower = labels.join(heard, labels.id == heard.dst, "left").select("id", F.least("component", "least").alias("component"), F.col("component").alias("old"))
        jump = lower.select(F.col("id").alias("at"), F.col("component").alias("beyond"))
        new = cut(lower.join(jump, F.col("component") == F.col("at"), "left").select("id", F.least("component", "beyond").alias("component"), "old"))
        labels = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            return labels.withColumnRenamed("id", node)


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges.select("src", "dst")).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def trim(edges: DataFrame) -> DataFrame:
    """Remove nodes of degree 1 again and again until there are none; a tree leaves no edges."""
    now = edges
    while True:
        leaves = cut(degrees(now).where("degree = 1").select("id"))
        if leaves.isEmpty():
            return now
        now = cut(now.join(leaves, now.src == leaves.id, "left_anti").join(leaves, now.dst == leaves.id, "left_anti"))


def contract_chains(edges: DataFrame) -> DataFrame:
    """Edges between nodes of degree other than 2, each as long as the chain that it stands for.

    src, dst, dist, hops.  Chains are components of the nodes of degree 2; pure
    cycles have no end and are dropped.
    """
    both = undirected(edges)
    degree = degrees(edges)
    inner = degree.where("degree = 2").select("id")
    links = both.join(inner, both.src == inner.id, "left_semi").join(inner, both.dst == inner.id, "left_semi")
    chains = components(inner, links)
    a = chains.select(F.col("id").alias("src"), F.col("component").alias("ca"))
    b = chains.select(F.col("id").alias("dst"), F.col("component").alias("cb"))
    placed = both.where("src < dst").join(a, "src", "left").join(b, "dst", "left")
    direct = placed.where("ca is null and cb is null").select("src", "dst", "dist", F.lit(1).cast("long").alias("hops"))
    in_chain = placed.where("ca is not null or cb is not null").withColumn("chain", F.coalesce("ca", "cb"))
    ends = F.flatten(F.collect_list(F.when(F.col("ca").isNull(), F.array("src")).when(F.col("cb").isNull(), F.array("dst")).otherwise(F.array().cast(ArrayType(edges.schema["src"].dataType)))))
    whole = in_chain.groupBy("chain").agg(F.sum("dist").alias("dist"), F.count("*").alias("hops"), F.sort_array(ends).alias("ends")).where(F.size("ends") == 2)
    return direct.unionByName(whole.select(F.col("ends")[0].alias("src"), F.col("ends")[1].alias("dst"), "dist", "hops"))


def chain_paths(edges: DataFrame) -> DataFrame:
    """start, first, node, at, ends: each chain of nodes of degree 2 as a path from one end, with the distance walked to each node.

    first: the node after the start, which tells chains of one start apart; the
    path's last row has ends = true.  Of a path's two directions that of least
    (start, first) is given; pure cycles have no end and are dropped.  Places
    learn their distance by doubling: each directed edge knows how far back it
    has looked, so rounds grow with the logarithm of the longest chain.
    """
    both = cut(undirected(edges.select("src", "dst", "dist")))
    inner = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where("n = 2").select("id")
    came = both.join(inner, both.dst == inner.id, "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("pa"), F.col("dist").alias("acc"))
    led = both.join(came, "src").where("pa <> dst").select("src", "dst", "dist", "acc", "pa", F.col("src").alias("pb"))
    heads = both.join(inner, both.src == inner.id, "left_anti")
    none = F.lit(None).cast(edges.schema["src"].dataType)
    heads = heads.select("src", "dst", "dist", F.lit(0.0).alias("acc"), none.alias("pa"), none.alias("pb"), F.col("src").alias("start"), F.col("dst").alias("first"))
    now = cut(led.withColumn("start", none).withColumn("first", none).unionByName(heads))
    # after so many doublings only pure cycles still look back
    for _ in range(now.count().bit_length()):
        if now.where("pa is not null").isEmpty():
            break
        back = now.select(F.col("src").alias("pa"), F.col("dst").alias("pb"), F.col("acc").alias("more"), F.col("pa").alias("na"), F.col("pb").alias("nb"), F.col("start").alias("s"), F.col("first").alias("f"))
        ahead = now.where("pa is not null").join(back, ["pa", "pb"])
        ahead = ahead.select("src", "dst", "dist", (F.col("acc") + F.col("more")).alias("acc"), F.col("na").alias("pa"), F.col("nb").alias("pb"), F.col("s").alias("start"), F.col("f").alias("first"))
        now = cut(now.where("pa is null").unionByName(ahead))
    placed = now.where("pa is null").join(inner.select(F.col("id").alias("dst"), F.lit(False).alias("open")), "dst", "left")
    placed = placed.select("start", "first", F.col("src").alias("tail"), F.col("dst").alias("node"), (F.col("acc") + F.col("dist")).alias("at"), F.col("open").isNull().alias("ends"))
    chains = placed.where("ends and tail <> start and struct(start, first) <= struct(node, tail)").select("start", "first")
    return placed.join(chains, ["start", "first"], "left_semi").drop("tail")


def resample_chains(edges: DataFrame, step: float) -> DataFrame:
    """Edges src, dst, dist along each chain between its ends and the nodes kept on it, one whenever more than ``step`` has been walked."""
    from .ordered import resample_path

    paths = cut(chain_paths(edges))
    starts = paths.select("start", "first", F.col("start").alias("node"), F.lit(0.0).alias("at"), F.lit(False).alias("ends")).distinct()
    kept = resample_path(paths.where("not ends").unionByName(starts), "at", step, ("at",), ("start", "first")).unionByName(paths.where("ends"))
    w = W.partitionBy("start", "first").orderBy("at", "ends")
    pairs = kept.select(F.lag("node").over(w).alias("src"), F.col("node").alias("dst"), (F.col("at") - F.lag("at").over(w)).alias("dist"))
    return pairs.where("src is not null")


def nearest_link(a: DataFrame, b: DataFrame, cell: float = 1.0, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The one closest pair of nodes (id and axes) of two graphs, as an edge src, dst, dist; ties go to the least ids."""
    from .spatial import nearest

    pairs = nearest(a.withColumnRenamed("id", "src"), b.withColumnRenamed("id", "dst"), "src", "dst", cell, (), axes)
    return pairs.orderBy("distance", "src", "dst").limit(1).select("src", "dst", F.col("distance").alias("dist"))


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, id, dist: least distances from each source node by rounds of relaxation, until none falls (dist >= 0)."""
    both = cut(undirected(edges.select("src", "dst", "dist")))
    best = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist")))
    front = best
    while True:
        step = front.join(both.withColumnRenamed("dist", "w"), front.id == both.src).select("source", F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"))
        step = step.groupBy("source", "id").agg(F.min("dist").alias("dist"))
        front = cut(step.join(best.withColumnRenamed("dist", "known"), ["source", "id"], "left").where("known is null or dist < known").select("source", "id", "dist"))
        if front.isEmpty():
            return best
        best = cut(best.unionByName(front).groupBy("source", "id").agg(F.min("dist").alias("dist")))


def assemble(floors: DataFrame, rooms: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, type, parent_id) and edges of the hierarchy under one building node."""
    building = floors.sparkSession.createDataFrame([("building", "building", "building", None)], "id string, name string, type string, parent_id string")
    nodes = building.unionByName(floors.select(F.col("floor_id").alias("id"), "name", F.lit("floor").alias("type"), F.lit("building").alias("parent_id")))
    nodes = nodes.unionByName(rooms.select(F.col("room_id").alias("id"), "name", F.lit("room").alias("type"), F.col("floor_id").alias("parent_id")))
    nodes = nodes.unionByName(objects.select(F.col("object_id").alias("id"), "name", F.lit("object").alias("type"), F.col("room_id").alias("parent_id")))
    return nodes, nodes.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))
