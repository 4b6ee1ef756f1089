"""Ranked lexical search by dense blocked matrix products.

The items' terms make a compact vocabulary.  A first pass counts its terms in
each document; their frequencies give integer weights and impacts.  A second
pass lays a tile of documents out as a dense matrix of impacts over a tile of
the vocabulary, multiplies it with the items' weights by BLAS in float64, and
adds the products as 64-bit integers.  A tile of the vocabulary ends before any
item's partial sum could reach 2**53, so each product is exact.  Of each tile
the k best documents of an item go on, equal scores by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import forget, stored
from .text import LOWER, Words, column_bytes

#: Bytes that end a term: all of ASCII but digits and letters.
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Fixed values of the ranking: parts in a thousand, the share of length in a hundred, and the factor of m.
SCALE, LENGTH_SHARE, LENGTH_FACTOR = 1000, 75, 8
#: No impact reaches it: 10**9 tf div (1000 tf + 8 m) < 10**6.
MOST_IMPACT = SCALE * SCALE
#: Vocabulary terms that one round over the documents handles, but for the last item's.
ROUND_TERMS = 65536
DOC_TILE, TERM_TILE, ITEM_TILE = 1024, 1024, 256


def _terms(column: pa.Array) -> Words:
    return Words(*column_bytes(column), lower=True, gap=GAP)


def _counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, hash and count of the distinct terms of each text, in order of rows; and the rows' numbers of terms."""
    words = _terms(column)
    n = words.counts()
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words.hash, row))
    row, h = row[order], words.hash[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(row) else np.zeros(0, np.int64)
    return row[first], h[first], np.diff(np.r_[first, len(row)]), n


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """row (a number of each item's row), item, term (hash), times: the distinct terms of each item; an item without terms has no row."""
    keyed = items.select(F.col(item).alias("item"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    kind = dict(keyed.dtypes)["item"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, h, times, _ = _counts(batch.column("text"))
            at = pa.array(at)
            columns = [batch.column("row").take(at), batch.column("item").take(at), pa.array(h.view(np.int64)), pa.array(times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "item", "term", "times"])

    return stored(keyed.mapInArrow(split, f"row long, item {kind}, term long, times long"), "lexical-items")


def _count_documents(documents: DataFrame, doc: str, text: str, vocabulary: np.ndarray) -> DataFrame:
    """doc, n (terms of the document), terms (indices of the sorted vocabulary) and tf (their counts)."""
    rows = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _terms(batch.column("text"))
            n = words.counts()
            at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
            known = vocabulary[at] == words.hash
            key = np.repeat(np.arange(len(n)) * len(vocabulary), n)[known] + at[known]
            key.sort()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            tf, key = np.diff(np.r_[first, len(key)]), key[first]
            offsets = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * len(vocabulary)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % len(vocabulary), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n.astype(np.int64)), *lists], ["doc", "n", "terms", "tf"])

    return stored(rows.mapInArrow(count, f"doc {kind}, n long, terms array<int>, tf array<int>"), "lexical-counts")


def _frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary stands; each task sums its own first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in counted.select("terms").mapInArrow(add, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


def term_tiles(item: np.ndarray, term: np.ndarray, weight: np.ndarray, n_items: int, width: int = TERM_TILE, most: int = 2**53 // MOST_IMPACT) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tiles (terms, weights of items x terms) whose weights sum to at most ``most`` for any item; a larger single weight is dealt over several tiles."""
    order = np.lexsort((item, term))
    item, term, weight = item[order], term[order], weight[order]
    tiles, used, columns, load = [], [], [], np.zeros(n_items, np.int64)

    def close() -> None:
        if used:
            tiles.append((np.array(used), np.stack(columns, axis=1).astype(np.float64)))
        used.clear()
        columns.clear()
        load[:] = 0

    bounds = np.flatnonzero(np.r_[True, term[1:] != term[:-1], True]) if len(term) else np.zeros(1, np.int64)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        left = weight[a:b].copy()
        while left.any():
            now = np.minimum(left, most)
            if len(used) == width or (load[item[a:b]] + now > most).any():
                close()
            column = np.zeros(n_items, np.int64)
            column[item[a:b]] = now
            load += column
            used.append(term[a])
            columns.append(column)
            left -= now
            if left.any():
                close()
    close()
    return tiles


def best_of(group: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best rows of each group: highest scores, of equal ones the smallest ids, nulls last."""
    order = np.lexsort((doc, null, -score, group))
    g = group[order]
    start = np.searchsorted(g, g, "left")
    return order[np.arange(len(g)) - start < k]


def _search(counted: DataFrame, tiles: list, items: np.ndarray, size: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """row (an item's), doc, score, part (group of tasks): each task's k best documents of each item."""
    n_items = len(items)
    kind = dict(counted.dtypes)["doc"]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        doc_type = pa.int64()
        for whole in batches:
            doc_type = whole.schema.field("doc").type
            for first in range(0, whole.num_rows, DOC_TILE):
                batch = whole.slice(first, DOC_TILE)
                null = np.asarray(batch.column("doc").is_null())
                doc = batch.column("doc").fill_null(0).to_numpy().astype(np.int64)
                terms, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
                row = np.repeat(np.arange(len(doc)), batch.column("terms").value_lengths().to_numpy())
                m = 100 - LENGTH_SHARE + LENGTH_SHARE * batch.column("n").to_numpy() * n_docs // max(1, n_terms)
                impact = (SCALE**3 * tf) // (SCALE * tf + LENGTH_FACTOR * m[row])
                for lo in range(0, n_items, ITEM_TILE):
                    hi = min(lo + ITEM_TILE, n_items)
                    score = np.zeros((hi - lo, len(doc)), np.int64)
                    for used, weights in tiles:
                        place = np.full(size, -1)
                        place[used] = np.arange(len(used))
                        at = place[terms]
                        own = at >= 0
                        dense = np.zeros((len(used), len(doc)))
                        dense[at[own], row[own]] = impact[own]
                        score += (weights[lo:hi] @ dense).astype(np.int64)
                    # the k-th best of the tile and of the rows so far; all that reach it stay, ties too
                    least = np.ones(hi - lo, np.int64)
                    if len(doc) > k:
                        least = np.maximum(least, np.partition(score, len(doc) - k, axis=1)[:, len(doc) - k])
                    i, j = np.nonzero(score >= least[:, None])
                    new = (i + lo, score[i, j], null[j], doc[j])
                    best = [np.concatenate(x) for x in zip(best, new, strict=True)]
                kept = best_of(*best, k)
                best = [x[kept] for x in best]
        docs = pa.array(np.where(best[2], 0, best[3]), pa.int64(), mask=best[2]).cast(doc_type)
        yield pa.RecordBatch.from_arrays([pa.array(items[best[0]]), docs, pa.array(best[1]), pa.array(np.full(len(docs), _task_group()))], ["row", "doc", "score", "part"])

    return counted.where(F.size("terms") > 0).mapInArrow(rank, f"row long, doc {kind}, score long, part long")


def _task_group() -> int:
    """The group of at most 64 tasks that this one is of: the results of very many tasks are ranked in two steps."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() // 64 if context else 0


def search_items(items: DataFrame, documents: DataFrame, k: int = 10, item: str = "item_id", doc: str = "doc_id", text: str = "text", round_terms: int = ROUND_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 of each item, equal scores by ascending id (null last).

    Null and empty texts have no terms: such items find nothing, such documents
    count for nothing and are never found.  Repeated rows are items or documents
    of their own; so repeated item ids give a list each.  Empty tables give no
    rows; other columns are ignored, whatever their names.  Items are handled
    in rounds of about ``round_terms`` terms (always whole items), each of which
    reads the documents once; only a round's vocabulary, weights and
    frequencies reach the driver and the tasks.
    """
    terms = item_terms(items, item, text)
    total = terms.count()
    rounds = max(1, -(-total // round_terms))
    found = []
    for r in range(rounds if total else 0):
        own = terms.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r)
        part = own.select("row", "term", "times").toPandas()
        if not len(part):
            continue
        rows, at = np.unique(part["row"].to_numpy(), return_inverse=True)
        vocabulary, term = np.unique(part["term"].to_numpy().view(np.uint64), return_inverse=True)
        counted = _count_documents(documents, doc, text, vocabulary)
        sums = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).head()
        df = _frequencies(counted, len(vocabulary))
        weight = np.array([math.floor(1000 * math.log((2 * sums.docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        tiles = term_tiles(at, term, weight[term] * part["times"].to_numpy(), len(rows))
        best = _search(counted, tiles, rows, len(vocabulary), sums.docs, sums.terms, k)
        order = (F.desc("score"), F.col("doc").asc_nulls_last())
        # tasks' results are ranked by groups of tasks first
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("row", "part").orderBy(*order))).where(F.col("rank") <= k)
        best = stored(best.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k), "lexical-best")
        forget(counted)
        names = own.select("row", F.col("item").alias(item)).distinct()
        found.append(best.join(names, "row").select(item, F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc), "score"))
    if not found:
        return items.sparkSession.createDataFrame([], f"{item} {dict(items.dtypes)[item]}, rank int, {doc} {dict(documents.dtypes)[doc]}, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB's form of search_items(benchmark, documents) with its defaults.
LEXICAL_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWERED}, '{_TERM}') AS words FROM documents),
docs AS (SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n, words FROM words WHERE len(words) > 0),
sums AS (SELECT count(*) AS docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS terms FROM docs),
tfs AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM docs) GROUP BY row, term),
asked AS (SELECT item_row, item_id, term, count(*) AS times FROM (
  SELECT item_row, item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM (SELECT row_number() OVER () AS item_row, item_id, text FROM benchmark))
  GROUP BY item_row, item_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, sums GROUP BY term),
scores AS (SELECT a.item_row, any_value(a.item_id) AS item_id, t.row, any_value(d.doc_id) AS doc_id,
  CAST(sum(a.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 75 + (75 * d.n * s.docs) // s.terms)))) AS BIGINT) AS score
  FROM asked a JOIN tfs t USING (term) JOIN weights w USING (term) JOIN docs d ON d.row = t.row, sums s GROUP BY a.item_row, t.row),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
