"""Exact top-k by inner product over an inverted file of cells: cells whose bound can't beat the k-th best are not scored."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.vector import as_doubles, dot, norm
from ..session import cut, shared_folder


@dataclass
class Cells:
    """members: cell, shell, item and vector, stored by cell; blocks: cell, shell, n, reach; centres: cell, centre.

    A block holds the members of a cell at about one distance from its centre,
    at most ``reach``.
    """

    members: DataFrame
    blocks: DataFrame
    centres: DataFrame
    item: str
    vector: str


def _whole(vector: str, size: int):
    """True where the vector has that many components, all finite."""
    finite = F.forall(as_doubles(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) == size) & finite, F.lit(False))


def _fit(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Means of k-means from the sample's first rows; an empty cell keeps its centre."""
    centres = np.unique(sample[: 4 * cells], axis=0)[:cells]
    for _ in range(rounds):
        nearest = _nearest(sample, centres)
        sums, n = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)


def build(items: DataFrame, item: str, vector: str = "embedding", cells: int = 64, sample: int = 4096, rounds: int = 8, seed: int = 3, spread: int = 8) -> Cells:
    """Every item in the cell of its nearest centre and the shell of its distance from it.

    Centres come from at most ``sample`` rows of least seeded hash; they decide
    what a search costs, never what it finds.  Distances in a shell differ by a
    factor of at most 2**(1/4).  A cell is written by up to ``spread`` tasks.
    Vectors that are null, of another length than that of the least item, or hold
    null or non-finite components take no part.
    """
    spark = items.sparkSession
    size = items.where(F.size(vector) > 0).agg(F.min_by(F.size(vector), F.col(item))).head()[0] or 0
    rows = items.where(_whole(vector, size)).select(item, as_doubles(vector).alias(vector))
    drawn = rows.orderBy(F.xxhash64(item, F.lit(seed)), item).limit(sample).select(vector).collect()
    centres = _fit(np.array([r[0] for r in drawn]).reshape(len(drawn), size), cells, rounds)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf[vector].to_numpy())
                at = _nearest(v, centres)
                far = np.sqrt(((v - centres[at]) ** 2).sum(1))
                shell = np.floor(4 * np.log2(np.maximum(far, 1e-9))).astype(np.int32)
                yield pdf.assign(cell=at.astype(np.int32), shell=shell, far=far)

    kind = dict(items.dtypes)[item]
    placed = rows.mapInPandas(place, f"{item} {kind}, {vector} array<double>, cell int, shell int, far double")
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    placed.repartition("cell", F.pmod(F.xxhash64(item), F.lit(spread))).write.partitionBy("cell").parquet(path)
    members = spark.read.schema(f"{item} {kind}, {vector} array<double>, shell int, far double, cell int").parquet(path)
    blocks = cut(members.groupBy("cell", "shell").agg(F.count("*").alias("n"), F.max("far").alias("reach")))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    return Cells(members, blocks, table, item, vector)


def top_k(index: Cells, queries: DataFrame, k: int, query: str = "query_id", vector: str = "query") -> DataFrame:
    """query, rank, item, sim, scored: the k items of largest inner product of each query, ties to the smaller item.

    No item of a block is nearer than query x centre + |query| x reach.  Blocks
    of the largest bounds that together hold k items are scored first; then
    those whose bound reaches the k-th best of these.  ``scored`` counts the
    items that were scored for the query.  A query whose vector is null, of
    another length, or not finite finds nothing.  Queries are a stated set:
    query and index meet by their blocks, items by cell and shell.
    """
    first = index.centres.head()
    asked = queries.select(query, as_doubles(vector).alias("_q")).where(_whole("_q", len(first.centre) if first else 0))
    near = asked.crossJoin(index.centres).select(query, "_q", "cell", dot("_q", "centre").alias("_at"), norm("centre").alias("_c"))
    reach = norm("_q") * F.col("reach")
    slack = (norm("_q") * (F.col("_c") + F.col("reach")) + 1) * 1e-9
    bounds = near.join(index.blocks, "cell").select(query, "_q", "cell", "shell", "n", (F.col("_at") + reach + slack).alias("bound"))
    before = F.sum("n").over(W.partitionBy(query).orderBy(F.desc("bound"), "cell", "shell").rowsBetween(W.unboundedPreceding, -1))
    bounds = cut(bounds.withColumn("held", F.coalesce(before, F.lit(0))))

    def scored(blocks: DataFrame) -> DataFrame:
        met = index.members.join(blocks.select(query, "_q", "cell", "shell"), ["cell", "shell"])
        return met.select(query, index.item, dot(index.vector, "_q").alias("sim"))

    order = W.partitionBy(query).orderBy(F.desc("sim"), index.item)
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    start = cut(best(scored(bounds.where(F.col("held") < k))))
    least = start.where(F.col("rank") == k).select(query, F.col("sim").alias("least"))
    # a query with fewer than k items in all has met them at the start
    more = bounds.where(F.col("held") >= k).join(least, query).where(F.col("bound") >= F.col("least"))
    found = best(start.drop("rank").unionByName(scored(more)))
    seen = bounds.where(F.col("held") < k).select(query, "n").unionByName(more.select(query, "n")).groupBy(query).agg(F.sum("n").alias("scored"))
    return found.join(seen, query).select(query, "rank", index.item, "sim", "scored")
