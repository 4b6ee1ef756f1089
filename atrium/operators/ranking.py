"""Similarity search and ranking over embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.vector import dot


def score(items: DataFrame, queries: DataFrame, vector: str = "embedding", query_vector: str = "query") -> DataFrame:
    """Every item against every row of a stated set of queries (one vocabulary or a few prompts): column sim.

    The stated set is a dimension table whose rows don't grow with the items.
    """
    return items.crossJoin(queries).withColumn("sim", dot(vector, query_vector))


def top_k(scored: DataFrame, k: int, keys: tuple[str, ...] = (), order: tuple[Column, ...] = ()) -> DataFrame:
    """k rows of largest sim, ties in the given order; a global top-k needs no sort of all rows."""
    order = (F.desc("sim"), *order)
    if not keys:
        return scored.orderBy(*order).limit(k)
    w = W.partitionBy(*keys).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def argmax_label(scored: DataFrame, keys: tuple[str, ...], label: str) -> DataFrame:
    """The label of largest sim of each key; ties go to the smallest label."""
    best = F.min_by(F.struct(label, "sim"), F.struct(-F.col("sim"), F.col(label)))
    return scored.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col(f"best.{label}").alias(label), F.col("best.sim").alias("sim"))


def best_group(scored: DataFrame, group: str, k: int) -> DataFrame:
    """The k groups whose best member is nearest (rooms by their views)."""
    return scored.groupBy(group).agg(F.max("sim").alias("sim")).orderBy(F.desc("sim"), group).limit(k)


def near_best(scored: DataFrame, margin: float = 1e-3) -> DataFrame:
    """All rows whose sim is less than ``margin`` below the best one."""
    best = scored.agg(F.max("sim").alias("best"))
    return scored.join(F.broadcast(best)).where(F.col("best") - F.col("sim") < margin).drop("best")


def top_k_with_negatives(scored: DataFrame, item: str, k: int, query: str = "query_id", wanted: int = 0) -> DataFrame:
    """Items whose nearest prompt is the wanted one, by its sim; if there is none, the plain top-k.

    scored has a row for each item and prompt (the wanted one and negatives).
    """
    w = W.partitionBy(item)
    first = F.row_number().over(w.orderBy(F.desc("sim"), query))
    own = scored.withColumn("first", first).withColumn("wins", F.max(F.when((F.col("first") == 1) & (F.col(query) == wanted), 1).otherwise(0)).over(w)).where(F.col(query) == wanted)
    any_wins = own.agg(F.max("wins").alias("any"))
    return own.join(F.broadcast(any_wins)).where((F.col("wins") == 1) | (F.col("any") == 0)).drop("any", "first").orderBy(F.desc("sim"), item).limit(k)


def majority(votes: DataFrame, keys: tuple[str, ...], label: str) -> DataFrame:
    """Most frequent label; ties go to the smallest."""
    counts = votes.groupBy(*keys, label).agg(F.count("*").alias("votes"))
    best = F.min_by(F.struct(label, "votes"), F.struct(-F.col("votes"), F.col(label)))
    return counts.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col(f"best.{label}").alias(label), F.col("best.votes").alias("votes"))


def medoids(members: DataFrame, centres: DataFrame, cluster: str, item: str, vector: str = "embedding", centre: str = "mean_vector") -> DataFrame:
    """Of each cluster the member with the largest dot product with the centre; ties go to the smallest id."""
    scored = members.join(centres, cluster).withColumn("sim", dot(vector, centre))
    best = F.min_by(F.struct(item, "sim"), F.struct(-F.col("sim"), F.col(item)))
    return scored.groupBy(cluster).agg(best.alias("best")).select(cluster, F.col(f"best.{item}").alias(item), F.col("best.sim").alias("sim"))
