"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Vectors are lengthened by one component so that all have one length; then the
nearest by inner product are the nearest on a sphere, and a graph of neighbours
holds what a search needs.  The graph starts from neighbours within tiles of a
few orders by random hyperplanes.  In each round a node's neighbours, and a sample of
those that it is a neighbour of, meet each other: a join brings the vectors of
all neighbours of a tile's nodes together once, products of pairs not met before
give candidates, and a merge keeps each node's best.  Rounds end when few links
are new.  Queries start from their own links and expand the best nodes of their
beam, again by joins of tiles, until no node of the beam is left unexpanded.

Equal vectors are one node; its rows come in again at the end.  So a vector that
a third of all rows repeat is one node of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import forget, placed, stored

#: Links of a node, sampled links back to it, nodes of a tile, tilings to start from, share of new links that ends the rounds, and nodes of a query's beam.
LINKS, BACK, TILE, TILINGS, SETTLED, BEAM = 40, 40, 1024, 3, 0.01, 120
#: From this number of tiles on, tiles get larger with more nodes, until they are so many times as large.
FEW_TILES, LARGEST = 10, 3
#: Candidates that a tile gathers before it drops all but each node's best.
_GATHERED = 2_000_000
#: The rounds of NN-descent end here at the latest, settled or not; it is the graph that is unfinished then, no row is left out.
ROUNDS = 15
_PLANES = 24


def usable(rows: DataFrame, item: str, vector: str) -> DataFrame:
    """item and v of the rows that take part: with an id, and a vector without null or non-finite components that isn't zero."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(item).cast("long").alias("item"), F.col(vector).alias("v")).where(F.col("item").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    """A list column of vectors of one length as float64 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _lists(offsets: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(c)) for c in columns]


def _sphere(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of length 1 in float32: v over the longest length, and what that lacks of 1."""
    x = v / longest
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


def top_links(node: np.ndarray, link: np.ndarray, like: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k likest distinct links of each node, by node; of a repeated link the one that isn't fresh counts."""
    order = np.lexsort((fresh, link, node))
    node, link, like, fresh = node[order], link[order], like[order], fresh[order]
    first = np.r_[True, (node[1:] != node[:-1]) | (link[1:] != link[:-1])] if len(node) else np.zeros(0, bool)
    node, link, like, fresh = node[first], link[first], like[first], fresh[first]
    order = np.lexsort((link, -like, node))
    node, link, like, fresh = node[order], link[order], like[order], fresh[order]
    best = np.arange(len(node)) - np.searchsorted(node, node, "left") < k
    return node[best], link[best], like[best], fresh[best]


_LINK_ROWS = "node long, cell long, links array<long>, likes array<float>, fresh array<boolean>"
#: What a merge reads: links of many nodes of a cell in a row.
_FOUND_ROWS = "cell long, nodes array<long>, links array<long>, likes array<float>, fresh array<boolean>"
#: Cells of a tile; candidates go from a tile to a cell as one row.
_CELLS = 16


def _link_table(node, link, like, fresh, cell: np.ndarray, every: np.ndarray) -> pa.Table:
    """Rows of _LINK_ROWS from links ordered by node; every: the nodes, ascending, with or without links; cell: theirs."""
    offsets = np.r_[np.searchsorted(node, every, "left"), len(node)]
    return pa.Table.from_arrays([pa.array(every), pa.array(cell), *_lists(offsets, link, like.astype(np.float32), fresh)], ["node", "cell", "links", "likes", "fresh"])


def tile_size(n: int, tile: int) -> int:
    """Nodes of a tile for n nodes: ``tile``, and for more than FEW_TILES tiles as the root of n, up to LARGEST times as many.

    A tile gets each vector that its nodes' members need once, so up to the
    number where a node's members are all its own, larger tiles bring fewer.
    Tiles of one size would each need nearly all vectors of a middling table,
    whose number times that of the tiles is as the square of n.
    """
    return int(tile * min(LARGEST, max(1.0, (n / (FEW_TILES * tile)) ** 0.5)))


def _tiled(nodes: DataFrame, width: int, longest: float, tile: int, seed: int) -> DataFrame:
    """node, v, tile, cell: tiles, and cells of these, of the order by signs of projections on random directions, then by one more projection."""
    kind = dict(nodes.dtypes)["v"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).normal(size=(width + 1, _PLANES + 1)).astype(np.float32)
        for batch in batches:
            p = _sphere(_matrix(batch.column("v")), longest) @ planes
            code = (p[:, :_PLANES] > 0) @ (1 << np.arange(_PLANES, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("v"), pa.array(code), pa.array(p[:, -1].astype(np.float64))], ["node", "v", "code", "along"])

    signed = stored(nodes.mapInArrow(sign, f"node long, v {kind}, code long, along double").withColumn("one", F.lit(1)), "ann-signs")
    at = placed(signed, "one", [F.col("code"), F.col("along"), F.col("node")])
    cell = F.floor(F.col("at") / max(1, tile // _CELLS)).cast("long")
    return stored(at.select("node", "v", F.floor(cell / _CELLS).cast("long").alias("tile"), cell.alias("cell")), "ann-nodes")


def _first_links(nodes: DataFrame, longest: float, k: int) -> DataFrame:
    """Each node's k likest nodes of its own tile."""

    def within(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("node").to_numpy())
        node = table.column("node").to_numpy()[order]
        y = _sphere(_matrix(table.column("v"))[order], longest)
        m = min(k, len(node) - 1)
        near, likes = np.zeros((len(node), m), np.int64), np.zeros((len(node), m), np.float32)
        for a in range(0, len(node) if m else 0, 512):
            like = y[a : a + 512] @ y.T
            like[np.arange(len(like)), np.arange(a, a + len(like))] = -np.inf
            near[a : a + 512] = np.argpartition(-like, m - 1, axis=1)[:, :m]
            likes[a : a + 512] = np.take_along_axis(like, near[a : a + 512], 1)
        i = np.repeat(np.arange(len(node)), m)
        links = top_links(node[i], node[near.ravel()], likes.ravel(), np.ones(len(i), bool), k)
        return _link_table(*links, table.column("cell").to_numpy()[order], node)

    return stored(nodes.groupBy("tile").applyInArrow(within, _LINK_ROWS), "ann-links")


def _around(graph: DataFrame, back: int, seed: int) -> DataFrame:
    """node, tile, members and fresh: each node's links and a sample of ``back`` of the nodes that link to it."""
    there = graph.select("node", F.explode(F.arrays_zip("links", "fresh")).alias("l")).select(F.col("l.links").alias("node"), F.col("node").alias("from"), F.col("l.fresh").alias("fresh"))
    # of very many links back to one node each task passes on its first few
    chance = W.partitionBy("node").orderBy(F.xxhash64("from", "node", F.lit(seed)), "from")
    drawn = there.withColumn("n", F.row_number().over(chance)).where(F.col("n") <= back).groupBy("node").agg(F.collect_list(F.struct("from", "fresh")).alias("back"))
    both = graph.join(drawn, "node", "left")
    none = F.array().cast("array<struct<from:bigint,fresh:boolean>>")
    back_links = F.coalesce("back", none)
    tile = F.floor(F.col("cell") / _CELLS).cast("long").alias("tile")
    return both.select("node", tile, F.concat("links", F.transform(back_links, lambda x: x["from"])).alias("members"), F.concat("fresh", F.transform(back_links, lambda x: x["fresh"])).alias("fresh"))


def _distinct_of(rows: DataFrame, lists: str, name: str) -> DataFrame:
    """tile, name: the distinct values of a list column of each tile; batches drop repeats before the shuffle."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(lists)
            tile = np.repeat(batch.column("tile").to_numpy(), column.value_lengths().fill_null(0).to_numpy())
            value = column.flatten().to_numpy()
            order = np.lexsort((value, tile))
            tile, value = tile[order], value[order]
            first = np.r_[True, (tile[1:] != tile[:-1]) | (value[1:] != value[:-1])] if len(tile) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(tile[first]), pa.array(value[first])], ["tile", name])

    return rows.select("tile", lists).mapInArrow(distinct, f"tile long, {name} long").distinct()


def _meet(around: DataFrame, nodes: DataFrame, graph: DataFrame, longest: float, k: int) -> DataFrame:
    """Candidates: of each tile's nodes, all pairs of members of which one is fresh, if they are liker than the worst link so far."""
    worst = graph.select("node", F.when(F.size("links") >= k, F.element_at("likes", -1)).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    known = nodes.select("node", "v", "cell").join(worst, "node")
    # a node without a fresh member has no pair to compare: its members' vectors stay where they are
    around = around.where(F.exists("fresh", lambda x: x))
    vectors = _distinct_of(around, "members", "node").join(known, "node")

    def pairs(table: pa.Table, seen: pa.Table) -> pa.Table:
        name = seen.column("node").to_numpy()
        order = np.argsort(name)
        name, worst = name[order], seen.column("worst").to_numpy()[order]
        y = _sphere(_matrix(seen.column("v"))[order], longest)
        members = table.column("members").combine_chunks()
        if not len(members.flatten()):
            return pa.Table.from_arrays([pa.array([], pa.int64()), *_lists(np.zeros(1), *[np.zeros(0, x) for x in (np.int64, np.int64, np.float32, bool)])], names)
        size = members.value_lengths().to_numpy()
        flat, new = np.searchsorted(name, members.flatten().to_numpy()), table.column("fresh").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        start, found, gathered = np.r_[0, np.cumsum(size)], [], 0
        for a in range(0, len(size), 128):
            b = min(a + 128, len(size))
            width = max(1, size[a:b].max())
            at = start[a:b, None] + np.arange(width)
            there = np.arange(width) < size[a:b, None]
            at = np.where(there, at, 0)
            who, first = flat[at], new[at] & there
            x = y[who]
            like = np.matmul(x, x.transpose(0, 2, 1))
            good = (like > worst[who][:, :, None]) & (first[:, :, None] | first[:, None, :]) & there[:, :, None] & there[:, None, :] & (who[:, :, None] != who[:, None, :])
            w, i, j = np.nonzero(good)
            u, c, s = who[w, i], who[w, j], like[w, i, j]
            _, once = np.unique(u * len(name) + c, return_index=True)
            found.append((u[once], c[once], s[once]))
            gathered += len(once)
            if gathered > _GATHERED:
                u, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
                found, gathered = [top_links(u, c, s, np.ones(len(u), bool), k)[:3]], 0
        u, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
        u, c, s, f = top_links(u, c, s, np.ones(len(u), bool), k)
        cell = seen.column("cell").to_numpy()[order][u]
        by_cell = np.argsort(cell, kind="stable")
        cells, first = np.unique(cell[by_cell], return_index=True)
        lists = _lists(np.r_[first, len(u)], *[x[by_cell] for x in (name[u], name[c], s.astype(np.float32), f)])
        return pa.Table.from_arrays([pa.array(cells), *lists], names)

    names = ["cell", "nodes", "links", "likes", "fresh"]
    return around.groupBy("tile").cogroup(vectors.groupBy("tile")).applyInArrow(pairs, _FOUND_ROWS)


def _as_found(graph: DataFrame, fresh: bool | None = None) -> DataFrame:
    """The graph's rows as a merge reads them: a link of each node to itself, of the least likeness, stands for the node."""
    old = "fresh" if fresh is None else F.transform("fresh", lambda _: F.lit(fresh))
    ends = {"links": F.col("node"), "likes": F.lit(-9.0).cast("float"), "fresh": F.lit(False)}
    rows = graph.withColumn("fresh", F.col(old) if isinstance(old, str) else old)
    rows = rows.withColumn("nodes", F.transform(F.concat("links", F.array("node")), lambda _: F.col("node")))
    return rows.select("cell", "nodes", *[F.concat(c, F.array(end)).alias(c) for c, end in ends.items()])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The graph of each node's k likest links among rows of _FOUND_ROWS; those of a cell stream through one task."""
    rows = found.repartition("cell").sortWithinPartitions("cell")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat(table: pa.Table) -> tuple[np.ndarray, ...]:
            lists = [table.column(c).combine_chunks() for c in ("nodes", "links", "likes", "fresh")]
            cell = np.repeat(table.column("cell").to_numpy(), lists[0].value_lengths().to_numpy())
            return cell, *[x.flatten().to_numpy(zero_copy_only=False) for x in lists]

        def graph_of(cell, node, link, like, fresh) -> pa.Table:
            every, first = np.unique(node, return_index=True)
            node, link, like, fresh = top_links(node, link, like, fresh, k + 1)
            own = (node == link) | (np.arange(len(node)) - np.searchsorted(node, node, "left") >= k)
            return _link_table(node[~own], link[~own], like[~own], fresh[~own], cell[first], every)

        waiting = None
        for batch in batches:
            now = flat(pa.Table.from_batches([batch]))
            now = now if waiting is None else tuple(np.concatenate(x) for x in zip(waiting, now, strict=True))
            # the last cell's rows may go on in the next batch: its best links so far wait, and its nodes' links to themselves
            last = int(np.searchsorted(now[0], now[0][-1], "left")) if len(now[0]) else 0
            if last:
                yield from graph_of(*[x[:last] for x in now]).to_batches()
            cell, node, link, like, fresh = (x[last:] for x in now)
            own = node == link
            best = top_links(node[~own], link[~own], like[~own], fresh[~own], k)
            waiting = (cell, *[np.concatenate([b, x[own]]) for b, x in zip(best, (node, link, like, fresh), strict=True)])
            waiting = (np.full(len(waiting[1]), cell[0] if len(cell) else 0), *waiting[1:])
        if waiting is not None and len(waiting[0]):
            yield from graph_of(*waiting).to_batches()

    return stored(rows.mapInArrow(merge, _LINK_ROWS), "ann-links")


def neighbour_graph(tilings: list[DataFrame], longest: float, links: int = LINKS, back: int = BACK, settled: float = SETTLED, rounds: int = ROUNDS, seed: int = 11) -> DataFrame:
    """node, cell, links, likes, fresh by NN-descent from tilings (node, v, tile, cell) of the same nodes; cell is the first one's.

    Links of one tiling alone would never lead out of a tile.
    """
    nodes = tilings[0]
    graph = _first_links(nodes, longest, links)
    for other in tilings[1:]:
        more = _first_links(other, longest, links).drop("cell").join(nodes.select("node", "cell"), "node")
        graph = _merged(_as_found(graph).unionByName(_as_found(more)), links)
    total = graph.count()
    for i in range(rounds):
        around = stored(_around(graph, back, seed + i), "ann-around")
        new = _merged(_as_found(graph, False).unionByName(_meet(around, nodes, graph, longest, links)), links)
        forget(graph)
        forget(around)
        graph = new
        fresh = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).head()[0] or 0
        if fresh <= settled * links * total:
            break
    return graph


_BEAM_ROWS = "node long, tile long, beam array<long>, scores array<double>, open array<long>"


def graph_search(asked: DataFrame, nodes: DataFrame, graph: DataFrame, longest: float, beam: int, back: int = BACK, seed: int = 5) -> DataFrame:
    """node, beam, scores: for each asked node (a column) the ``beam`` best nodes that greedy search finds, itself left out, with their inner products in float64."""
    paths = stored(_around(graph, back, seed).select("node", F.array_distinct("members").alias("members")), "ann-paths")
    states = graph.join(asked, "node", "left_semi").select("node", F.floor(F.col("cell") / _CELLS).cast("long").alias("tile"), F.array().cast("array<long>").alias("beam"), F.array().cast("array<double>").alias("scores"), F.array("node").alias("open"))
    states = stored(states, "ann-beams")
    while True:
        hops = stored(_distinct_of(states, "open", "node").join(paths, "node").select("tile", "node", "members"), "ann-hops")
        goals = _distinct_of(hops, "members", "node").union(states.select("tile", "node")).distinct().join(nodes.select("node", "v"), "node")
        none = F.lit(None)
        kinds = {"members": "array<long>", "v": dict(nodes.dtypes)["v"]}
        rows = hops.select("tile", "node", "members", none.cast(kinds["v"]).alias("v")).unionByName(goals.select("tile", "node", none.cast(kinds["members"]).alias("members"), "v"))

        def expand(table: pa.Table, near: pa.Table) -> pa.Table:
            is_hop = near.column("v").is_null().combine_chunks()
            hop, goal = near.filter(is_hop), near.filter(pa.compute.invert(is_hop))
            name = goal.column("node").to_numpy()
            order = np.argsort(name)
            name, v = name[order], _matrix(goal.column("v"))[order]
            start_of = {n: i for i, n in enumerate(hop.column("node").to_pylist())}
            members = hop.column("members").combine_chunks()
            size = members.value_lengths().to_numpy()
            start, flat = np.r_[0, np.cumsum(size)], members.flatten().to_numpy()
            out = []
            for node, old, scores, opened in zip(*(table.column(c).to_pylist() for c in ("node", "beam", "scores", "open")), strict=True):
                found = [flat[start[i] : start[i + 1]] for i in (start_of.get(o) for o in opened) if i is not None]
                new = np.setdiff1d(np.concatenate(found), np.array([*old, node])) if found else np.zeros(0, np.int64)
                x = v[np.searchsorted(name, node)]
                ids = np.concatenate([np.array(old, np.int64), new])
                like = np.concatenate([np.array(scores, np.float64), v[np.searchsorted(name, new)] @ x])
                best = np.lexsort((ids, -like))[:beam]
                out.append((ids[best], like[best], ids[best[best >= len(old)]]))
            lengths = lambda c: np.r_[0, np.cumsum([len(o[c]) for o in out])]
            columns = [_lists(lengths(c), np.concatenate([o[c] for o in out]))[0] for c in range(3)]
            return pa.Table.from_arrays([table.column("node"), table.column("tile"), *columns], ["node", "tile", "beam", "scores", "open"])

        new = stored(states.groupBy("tile").cogroup(rows.groupBy("tile")).applyInArrow(expand, _BEAM_ROWS), "ann-beams")
        forget(hops)
        forget(states)
        states = new
        if states.where(F.size("open") > 0).isEmpty():
            return states.select("node", "beam", "scores")


def nearest_items(rows: DataFrame, k: int = 20, every: int = 20, item: str = "vec_id", vector: str = "embedding", links: int = LINKS, back: int = BACK, beam: int = BEAM, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose id ``every`` divides, by inner product in float64, ties by smaller id.

    Rows without an id, and vectors that are null, zero or hold a null or
    non-finite component take no part; all others must be of one length, else a
    task raises.  A query's own row is no candidate, but rows that repeat its
    vector, or even its id, are.  Where there are at most k candidates, all
    come.  An empty table, or one without queries, gives no rows.  Other
    columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    own = usable(rows, item, vector).select("item", "v", F.xxhash64("v").alias("ha"), F.xxhash64(F.lit(1), "v").alias("hb"))
    own = stored(own, "ann-rows")
    width = own.select(F.size("v").alias("n")).head()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    nodes = own.groupBy("ha", "hb").agg(F.min("item").alias("node"), F.first("v").alias("v"))
    nodes = stored(nodes, "ann-classes")
    longest = float(nodes.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).head()[0])
    # rows of equal id with unlike vectors are nodes of one number; they are told apart by a number of their own
    nodes = stored(nodes.withColumnRenamed("node", "least").withColumn("node", F.monotonically_increasing_id()), "ann-numbered")
    tile = tile_size(nodes.count(), tile)
    tilings = [_tiled(nodes.select("node", "v"), width.n, longest, tile, seed) for seed in range(TILINGS)]
    graph = neighbour_graph(tilings, longest, links, back)
    asked_rows = own.where(F.col("item") % every == 0).select(F.col("item").alias("query_id"), "ha", "hb")
    asked = asked_rows.select("ha", "hb").distinct().join(nodes.select("ha", "hb", "node", "v", "least"), ["ha", "hb"])
    found = graph_search(asked.select("node"), tilings[0], graph, longest, max(beam, k + 1), back)
    # a node stands for rows; the k + 1 best nodes and the query's own hold its k best rows
    names = nodes.select("node", "ha", "hb", "least")
    near = found.select("node", F.explode(F.arrays_zip("beam", "scores")).alias("b")).select(F.col("node").alias("asked"), F.col("b.beam").alias("node"), F.col("b.scores").alias("score"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    near = near.unionByName(asked.select(F.col("node").alias("asked"), "node", square.alias("score"))).join(names, "node")
    order = W.partitionBy("asked").orderBy(F.desc("score"), "least", "node")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 2)
    copies = own.select("item", "ha", "hb").withColumn("n", F.row_number().over(W.partitionBy("ha", "hb").orderBy("item"))).where(F.col("n") <= k + 1).drop("n")
    listed = near.drop("n").join(copies, ["ha", "hb"])
    listed = listed.withColumn("n", F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "item"))).where(F.col("n") <= k + 1)
    lists = listed.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("n", "item", "score"))).alias("near"))
    lists = lists.join(names.withColumnRenamed("node", "asked"), "asked").select("ha", "hb", "near")
    answers = asked_rows.join(lists, ["ha", "hb"])
    # the query's own row is left out once
    at = F.array_position(F.transform("near", lambda x: x["item"]), F.col("query_id")).cast("int")
    rest = F.when(at > 0, F.filter("near", lambda x: x["n"] != at)).otherwise(F.col("near"))
    out = answers.select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.item").alias("vec_id"), F.col("b.score").alias("score"))
