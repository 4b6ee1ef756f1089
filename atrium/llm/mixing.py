"""Mixing sources to target weights, as SQL.

Sources weigh 1, 2, 3, repeating, in code point order, and share the total
size by capped water-filling: a source whose share exceeds ``max_epochs`` times
its size is clamped there and the excess is shared again by weight until no
source is above.  Sorted by size over weight, the clamped sources are a prefix,
so one pass of running sums over the table of sources finds the level.  A
source is then repeated whole floor(target / size) times, and the rest is taken
from its documents in seeded hash order, the last of them in part.  Running
sums are taken in two levels (hash slots of a source, then documents of a
slot), so that a source holding most rows is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, numbered, stored

#: Hash slots of each source; a slot holds a 4096th of a source's documents.
SLOT_DIGITS = 3


def source_targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """source, source_size -> further columns weight and target; the sources are a small table of sums."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weighed = sources.withColumn("weight", ((rank - 1) % 3 + 1).cast("long")).withColumn("cap", max_epochs * F.col("source_size"))
    ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(W.unboundedPreceding, -1)
    level = weighed.withColumn("share", (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    level = level.withColumn("fits", F.col("share") <= F.col("cap") / F.col("weight")).withColumn("share", F.when(F.col("fits"), F.col("share")))
    level = level.withColumn("level", F.first("share", ignorenulls=True).over(ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("cap") / F.col("weight") < F.col("level"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return level.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(documents: DataFrame, max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and taken (words the mix takes, repeats counted).

    A null or empty text has size 0 and takes 0; a null source is a source of
    its own, ordered last; rows repeated exactly are documents of their own.
    Of rows equal in hash and doc_id, longer ones come later.  Reruns agree.
    """
    sized = documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return _mixed(stored(sized, "mixing"), max_epochs, seed)


def _mixed(sized: DataFrame, max_epochs: int, seed: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """The mix of a table of sizes; ``extra`` columns (row keys) are handed through and break ties."""
    hashed = sized.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)).withColumn("slot", F.substring("hash", 1, SLOT_DIGITS))
    slots = hashed.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    targets = source_targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), max_epochs)
    start = F.sum("slot_size").over(W.partitionBy("source").orderBy("slot")) - F.col("slot_size")
    placed = slots.withColumn("slot_start", start).alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "s.slot", "slot_start", "source_size", "target")
    both = hashed.alias("d").join(placed.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.slot") == F.col("p.slot"))).select("doc_id", "d.source", "d.slot", "hash", "size", "slot_start", "source_size", "target", *extra)
    order = W.partitionBy("source", "slot").orderBy("hash", F.col("doc_id").asc_nulls_first(), "size", *extra).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    at = F.col("slot_start") + F.sum("size").over(order) - F.col("size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - at))
    return both.withColumn("part", part).select("doc_id", "source", "size", "source_size", "target", whole.alias("epochs"), "part", F.least(whole * F.col("size") + F.col("part"), max_epochs * F.col("size")).alias("taken"), *extra)


#: DuckDB's form of mix_sources(documents) with its defaults.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sources),
shares AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS share
  FROM weighed WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(share, (cap / weight, source IS NULL, source)) AS level FROM shares WHERE share <= cap / weight),
targets AS (
  SELECT source, source_size, coalesce(CASE WHEN cap / weight < level THEN CAST(cap AS DOUBLE) ELSE weight * level END, 0.0) AS target
  FROM weighed CROSS JOIN level),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY sha256('7:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start_at
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  least(epochs * size + greatest(0, least(size, CAST(round(target - epochs * source_size) AS BIGINT) - start_at)), 3 * size) AS taken
FROM placed
"""


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix repeats them; a part of a document is its first words, cut in the text.

    Documents without words (null or empty texts) stay once; a null source is a
    source of its own; repeated rows and rows without an id are taken one by
    one; an empty table stays empty; columns of any name are handed through.
    """
    columns, kinds = docs.columns, dict(docs.dtypes)
    own = numbered(docs)
    named = {c: own.columns[columns.index(c)] for c in ("doc_id", "source", "text")}
    text, kept = named["text"], own.columns
    keyed = stored(own.withColumn("row", F.monotonically_increasing_id()), "mix-docs")
    sized = keyed.select(F.col(named["doc_id"]).alias("doc_id"), F.col(named["source"]).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), "row")
    mixed = _mixed(stored(sized, "mix-sizes"), 3, 7, ("row",)).select("row", "epochs", "part", "size")
    rows = keyed.join(mixed, "row")
    # a document without words stays as it is: the mix has nothing to take from it
    parts = F.col("epochs").cast("int") + (F.col("part") > 0).cast("int")
    copies = F.when(F.col("size") == 0, F.array(F.lit(1))).when(parts > 0, F.sequence(F.lit(1), parts)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("copy", F.explode(copies)).withColumn("cut", F.when((F.col("copy") > F.col("epochs")) & (F.col("part") < F.col("size")), F.col("part")).otherwise(F.lit(-1)))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .text import Words, column_bytes

        for batch in batches:
            at = batch.column("cut").to_numpy()
            if (at >= 0).any():
                new = batch.column(text).to_pylist()
                for i in (at >= 0).nonzero()[0]:
                    w = Words(*column_bytes(pa.array([new[i]], pa.string())))
                    new[i] = w.buf[: w.end[at[i] - 1]].tobytes().decode() if at[i] else ""
                batch = batch.set_column(batch.schema.get_field_index(text), text, pa.array(new, pa.string()))
            yield batch.select(kept)

    out = rows.select(*kept, "cut").mapInArrow(shorten, ", ".join(f"{c} {kind}" for c, kind in own.dtypes)).toDF(*columns)
    return out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])).select(*columns) if "n_chars" in columns else out
