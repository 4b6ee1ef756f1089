"""Maximum-weight matching of two sides, component by component."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut
from .graph import components
from .spatial import keyed


def heaviest(links: list[list[tuple[int, float]]]) -> dict[int, int]:
    """column -> row of a matching of the largest sum of scores; links has (column, score > 0) of each row.

    Shortest augmenting paths with a heap.  A row may stay alone at the cost of
    0, which is a column -1 - row of its own.  Memory is that of the links.
    """
    owner: dict[int, int] = {}
    column: dict[int, int] = {}
    row_price = [0.0] * len(links)
    price: dict[int, float] = {}
    for start in range(len(links)):
        far: dict[int, float] = {}
        came: dict[int, int] = {}
        done: list[tuple[int, float]] = []
        settled: set[int] = set()
        heap: list[tuple[float, int]] = []
        row, base = start, 0.0
        while True:
            for at, score in (*links[row], (-1 - row, 0.0)):
                d = base - score - row_price[row] - price.get(at, 0.0)
                if at not in settled and d < far.get(at, float("inf")):
                    far[at], came[at] = d, row
                    heapq.heappush(heap, (d, at))
            base, end = heapq.heappop(heap)
            while end in settled:
                base, end = heapq.heappop(heap)
            settled.add(end)
            if end not in owner:
                break
            done.append((end, base))
            row = owner[end]
        row_price[start] += base
        for at, d in done:
            row_price[owner[at]] += base - d
            price[at] = price.get(at, 0.0) - (base - d)
        while True:
            row = came[end]
            owner[end] = row
            before = column.get(row)
            column[row] = end
            if row == start:
                break
            end = before
    return {at: row for at, row in owner.items() if at >= 0 and column[row] == at}


def match(scores: DataFrame, keys: tuple[str, ...], a: str = "a", b: str = "b", value: str = "score") -> DataFrame:
    """keys, a, b, score: a matching of each key's nodes with the largest sum of scores, as many pairs as the smaller side has nodes.

    Pairs that are absent, or whose score is null, NaN or below 0, score 0.  A
    pair given more than once has its mean score; rows without a or b drop out.
    Nodes are those that occur in scores, and may repeat over keys.  Only nodes
    that scores above 0 link, directly or not, compete: each such component is
    matched by itself, stars in the JVM and others from the list of their links
    in a task each.  Nodes left over are paired in order of their ids, score 0.
    """
    names = list(keys)
    clean = F.when(~F.isnan(F.col(value).cast("double")) & (F.col(value) > 0), F.col(value).cast("double")).otherwise(F.lit(0.0))
    given = scores.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = cut(given.groupBy(*names, a, b).agg(F.avg(clean).alias(value)))
    links = rows.where(F.col(value) > 0).withColumn("_id", keyed(keys, b))
    # nodes b of one a follow one another: a chain links them as well as all pairs would
    before = F.lag("_id").over(W.partitionBy(*names, a).orderBy(b))
    edges = links.select(F.col("_id").alias("src"), before.alias("dst")).where("dst is not null").distinct()
    parts = cut(links.join(components(links.select(F.col("_id").alias("id")), edges), F.col("_id") == F.col("id")).drop("_id", "id"))
    best = F.min_by(F.struct(*names, a, b, value), F.struct(-F.col(value), F.col(a), F.col(b)))
    stats = parts.groupBy("component").agg(((F.min(a) == F.max(a)) | (F.min(b) == F.max(b))).alias("star"), best.alias("best"))
    stars = stats.where("star").select("best.*")
    schema = rows.select(*names, a, b, value).schema

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = (a, b) if pdf[a].nunique() <= pdf[b].nunique() else (b, a)
        pdf = pdf.sort_values([one, two]).reset_index(drop=True)
        i, j = pdf[one].factorize()[0].tolist(), pdf[two].factorize(sort=True)[0].tolist()
        table: list[list[tuple[int, float]]] = [[] for _ in range(max(i) + 1)]
        place = {}
        for n, (x, y, score) in enumerate(zip(i, j, pdf[value].tolist(), strict=True)):
            table[x].append((y, score))
            place[x, y] = n
        return pdf.loc[sorted(place[x, y] for y, x in heaviest(table).items()), [*names, a, b, value]]

    others = parts.join(stats.where("not star").select("component"), "component", "left_semi")
    solved = others.groupBy("component").applyInPandas(solve, schema)
    found = cut(stars.unionByName(solved))

    def alone(node: str) -> DataFrame:
        same = lambda: [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*names, node)]
        left = rows.select(*names, node).distinct().alias("l").join(found.alias("r"), same(), "left_anti")
        return left.withColumn("_rank", F.row_number().over(W.partitionBy(*names).orderBy(node)))

    met = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*names, "_rank")]
    rest = alone(a).alias("l").join(alone(b).alias("r"), met).select(*[f"l.{c}" for c in names], a, b, F.lit(0.0).alias(value))
    return found.unionByName(rest)
