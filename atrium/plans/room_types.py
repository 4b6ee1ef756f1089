"""Types of rooms from the names of the objects in them: smoothed log odds of co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def type_weights(known: DataFrame, smoothing: float = 1.0, room_type: str = "room_type", name: str = "name") -> DataFrame:
    """room_type, name, weight: how much more likely a name is in rooms of a type than in others, as the log of odds.

    known: a row an object, with its name and the type of its room; rows with a
    null in either are left out.  Counts of names are smoothed by adding
    ``smoothing`` to each, so that every name has a finite weight in every type.
    Types and names are vocabularies; rows grow with their product, not with objects.
    """
    counts = known.where(F.col(room_type).isNotNull() & F.col(name).isNotNull()).groupBy(room_type, name).agg(F.count("*").alias("n"))
    of_type, of_name = counts.groupBy(room_type).agg(F.sum("n").alias("of_type")), counts.groupBy(name).agg(F.sum("n").alias("of_name"))
    total = of_name.agg(F.sum("of_name").alias("total"), F.count("*").alias("names"))
    every = of_type.crossJoin(of_name).crossJoin(total).join(counts, [room_type, name], "left").fillna(0, ["n"])
    within = (F.col("n") + smoothing) / (F.col("of_type") + smoothing * F.col("names"))
    without = (F.col("of_name") - F.col("n") + smoothing) / (F.col("total") - F.col("of_type") + smoothing * F.col("names"))
    return every.select(room_type, name, F.log(within / without).alias("weight"))


def room_types(objects: DataFrame, weights: DataFrame, room: str = "room_id", keys: tuple[str, ...] = (), room_type: str = "room_type", name: str = "name", among: list[str] | None = None) -> DataFrame:
    """keys, room, room_type, score: the type whose weights, summed over a room's objects with repeats, are largest.

    Objects are counted by room and name before they meet weights.  Scores count
    to nine digits, equal ones go to the least type; with ``among`` only these
    types are asked for.  Names without weights don't count, and a room of such
    names alone has no row.
    """
    asked = weights if among is None else weights.where(F.col(room_type).isin(among))
    counted = objects.groupBy(*keys, room, name).agg(F.count("*").alias("n"))
    scores = counted.join(asked, name).groupBy(*keys, room, room_type).agg(F.round(F.sum(F.col("n") * F.col("weight")), 9).alias("score"))
    best = scores.groupBy(*keys, room).agg(F.min(F.struct((-F.col("score")).alias("less"), room_type)).alias("b"))
    return best.select(*keys, room, F.col(f"b.{room_type}").alias(room_type), (-F.col("b.less")).alias("score"))
