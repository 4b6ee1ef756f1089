"""Repeated byte strings by induced suffix sorting over winnowed samples.

1. The sampled suffixes are those at winnowed anchors: every string of
   ``window`` bytes holds one, at a place that its content alone decides.  The
   suffixes between two anchors form a run; runs that cover the same text are a
   class, and one member stands for it (repeats.py).  Suffixes whose anchor gram
   occurs once can't repeat and drop out here.
2. Shards are dealt by anchor gram, so suffixes with a common prefix of
   ``window`` bytes meet.  Spark's external sorter, which spills to disk, puts a
   shard's sampled suffixes in order, as far as the longest length asked for;
   neighbours get their common-prefix length (LCP).
3. All other suffixes are induced from these, right to left: the order of
   suffixes that start d bytes before their anchors is that of (byte, rank of the
   suffix one byte on), a stable sort by one byte.  The LCP of neighbours is 1 +
   the least LCP between the ranks that induced them.
4. A suffix whose LCP with a neighbour reaches a length starts a repeated string
   of that length.

Suffixes that differ in a byte before the anchor never meet again, so each step
works on what is still together.  Shards are cut at gram boundaries into pieces
of a few MB; a gram with very many classes is compared by hashes of its strings
as a join instead.  No suffix array of the whole corpus is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .extension import by_key, common_prefixes, extend_back, stretches
from .repeats import covered, find_classes, many_classes, prefix, span, texts_of, with_spans
from .text import _TABLE, SPACE, column_bytes, mix

#: Bytes of text around anchors that one pass of the induction holds.
CHUNK = 4 << 20


def _around(documents: DataFrame, runs: DataFrame, reach: int) -> DataFrame:
    """key, doc, h, at (the anchor), low, back and ahead: the text before a run's anchor and from it on, as far as its strings reach."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column_bytes(batch.column("text"))
            for i in range(batch.num_rows):
                first, count, low, key = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("first", "count", "low", "key"))
                raw = buf[off[i] : off[i + 1]].tobytes()
                at = first + count - 1 + low
                end = first + count - 1 + reach
                back = [raw[a:b] for a, b in zip(first.tolist(), at.tolist(), strict=True)]
                ahead = [raw[a:b] for a, b in zip(at.tolist(), end.tolist(), strict=True)]
                own = [pa.array(np.full(len(first), batch.column(c)[i].as_py(), np.int64)) for c in ("doc", "h")]
                yield pa.RecordBatch.from_arrays([pa.array(key), *own, pa.array(at), pa.array(low), pa.array(back, pa.binary()), pa.array(ahead, pa.binary())], ["key", "doc", "h", "at", "low", "back", "ahead"])

    return texts_of(documents, runs).mapInArrow(cut, "key long, doc long, h long, at long, low long, back binary, ahead binary")


def induce(group: np.ndarray, low: np.ndarray, back: tuple[np.ndarray, np.ndarray], lcp: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """hit[k, row, d]: the suffix d bytes before a row's anchor has a common prefix of lengths[k] bytes with another one.

    Rows are in order of (group, suffix at the anchor), lcp is theirs.  back: the
    bytes before the anchors and their bounds; suffixes nearer to the anchor than
    ``low`` are sorted but not reported, they belong to the next run.
    """
    raw, off = back
    hit = np.zeros((len(lengths), len(low), int(np.diff(off).max(initial=0)) + 1), bool)

    def report(d: int, order: np.ndarray, same: np.ndarray, lcp: np.ndarray) -> None:
        active = low[order] <= d
        for k, length in enumerate(lengths):
            pair = same & (lcp[1:] + d >= length)
            hit[k, order[active & (np.append(False, pair) | np.append(pair, False))], d] = True

    extend_back(group, raw, off, lcp, report)
    return hit


def _induced(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """doc, h, first, last, length: stretches of places where a repeated string of a length starts."""

    def judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, doc, h, at, low = (table.column(c).to_numpy() for c in ("key", "doc", "h", "at", "low"))
        group = np.cumsum(np.append(False, key[1:] != key[:-1]))
        hit = induce(group, low, column_bytes(table.column("back")), common_prefixes(*column_bytes(table.column("ahead"))), lengths)
        for k, length in enumerate(lengths):
            row, near, far = stretches(hit[k])
            yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(h[row]), pa.array(at[row] - far), pa.array(at[row] - near), pa.array(np.full(len(row), length))], ["doc", "h", "first", "last", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "ahead", CHUNK):
            if len(table) > 1:
                yield from judge(table)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", "ahead").mapInArrow(run, "doc long, h long, first long, last long, length long")


def _by_string(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """The same for grams with very many classes, as a join on hashes of their strings."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc, h, at, low, back, ahead in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "h", "at", "low", "back", "ahead")), strict=True):
                total = prefix(_TABLE[np.frombuffer(back + ahead, np.uint8)])
                for length in lengths:
                    start = np.arange(max(0, min(len(back) - low + 1, len(back) + len(ahead) - length + 1)))
                    own = mix(span(total, start, start + length) ^ np.uint64(key & (1 << 64) - 1)).view(np.int64)
                    same = [pa.array(np.full(len(start), x, np.int64)) for x in (doc, h, length)]
                    yield pa.RecordBatch.from_arrays([pa.array(own), *same, pa.array(start + at - len(back))], ["string", "doc", "h", "length", "first"])

    table = stored(rows.mapInArrow(hashes, "string long, doc long, h long, length long, first long"), "strings")
    more = table.groupBy("string", "length").agg(F.count("*").alias("n")).where("n > 1")
    return table.join(more, ["string", "length"]).select("doc", "h", "first", F.col("first").alias("last"), "length")


def repeated_strings(documents: DataFrame, lengths: tuple[int, ...] = (400,), gram: int = 0, most_classes: int = 20000, **sampling) -> DataFrame:
    """doc, h and spans of all documents in which a string of some length also starts elsewhere.

    A span has the first and last start and the length, which is 0 if all
    lengths repeat there as far as the text goes.  gram: bytes of an anchor gram,
    a quarter of the least length by default.
    """
    window, reach = min(lengths), max(lengths)
    found = find_classes(documents, "bytes", window, gram or window // 4, False, reach, **sampling)
    open_runs = found.where("stands").select("key", "doc", "h", "first", "count", "low")
    hot = many_classes(open_runs, most_classes)
    out = found.where("repeat").select("doc", "h", "first", (F.col("first") + F.col("count") - 1).alias("last"), F.lit(0).cast("long").alias("length"))
    if hot is not None:
        out = out.unionByName(_by_string(_around(documents, open_runs.join(hot, "key", "left_semi"), reach), lengths))
        open_runs = open_runs.join(hot, "key", "left_anti")
    out = out.unionByName(_induced(_around(documents, open_runs, reach), lengths))
    return out.groupBy("doc", "h").agg(F.collect_list(F.struct("first", "last", "length")).alias("spans"))


def _spans(batch: pa.RecordBatch, i: int, n: int, length: int) -> np.ndarray | None:
    """Which of a document's n bytes lie in repeated strings of a length; None if none."""
    if not batch.column("first")[i].is_valid:
        return None
    first, last, own = (batch.column(c)[i].values.to_numpy() for c in ("first", "last", "length"))
    last = np.minimum(last, n - length)
    fits = ((own == 0) | (own == length)) & (last >= first)
    return covered(n, first[fits], last[fits], length) if fits.any() else None


def words_between(raw: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number of words (cut ones included) of each stretch that is gone."""
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word = ~SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    total = np.concatenate([[0], np.cumsum(first)])
    return start, end, total[end] - total[start] + (word[start] & ~first[start])


def long_passages(raw: np.ndarray, gone: np.ndarray, words: int) -> np.ndarray:
    """gone without the stretches that hold fewer words."""
    start, end, n = words_between(raw, gone)
    step = np.zeros(len(gone) + 1, np.int8)
    step[start[n >= words]] = 1
    step[end[n >= words]] = -1
    return np.cumsum(step[:-1]).astype(bool)


def remove_repeated_bytes(documents: DataFrame, window: int = 400, shorter: int = 0, words: int = 51, most_classes: int = 20000, **sampling) -> DataFrame:
    """Exact dedup by bytes: drop each byte covered by a window-long string that also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans and kept_sha256.  With
    ``shorter``, also n_passage_bytes: the bytes of passages of at least so many
    ``words`` that lie in strings of ``shorter`` bytes which also start elsewhere.
    A null text is empty; texts shorter than the window keep all; a repeated row
    repeats all strings of its text.  Further columns are ignored.
    """
    spans = repeated_strings(documents, (window, shorter) if shorter else (window,), most_classes=most_classes, **sampling)
    more = ["n_passage_bytes"] if shorter else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column_bytes(batch.column("text"))
            removed, pieces, digest, passages = [], [], [], []
            for i in range(batch.num_rows):
                raw = buf[off[i] : off[i + 1]]
                gone = _spans(batch, i, len(raw), window)
                removed.append(0 if gone is None else int(gone.sum()))
                pieces.append(0 if gone is None else int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                digest.append(hashlib.sha256((raw if gone is None else raw[~gone]).tobytes()).hexdigest())
                if shorter:
                    near = _spans(batch, i, len(raw), shorter)
                    passages.append(0 if near is None else int(long_passages(raw, near, words).sum()))
            extra = [pa.array(passages, pa.int64())] if shorter else []
            yield pa.RecordBatch.from_arrays([batch.column("own_0"), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(pieces, pa.int64()), pa.array(digest, pa.string()), *extra], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *more])

    return with_spans(documents, spans, ["doc_id"]).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + "".join(f", {c} long" for c in more))


def whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone without the bytes of characters that it covers in part only."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    if not len(lead):
        return gone
    every = np.logical_and.reduceat(gone, lead)
    return np.repeat(every, np.diff(np.append(lead, len(raw))))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str, length: int = 200, words: int = 51) -> DataFrame:
    """The documents without passages of over 50 words that also stand elsewhere, at every place, in whole characters.

    A passage is a stretch covered by strings of ``length`` bytes that also start
    anywhere else, with at least so many ``words``.  n_chars follows the text.
    Null texts stay null, repeated rows lose what they repeat, an empty table
    stays empty, and any further columns are handed through.
    """
    columns, kinds = docs.columns, dict(docs.dtypes)
    spans = repeated_strings(docs, (length,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(f"own_{columns.index('text')}")
            if batch.column("first").null_count < batch.num_rows:
                buf, off = column_bytes(batch.column("text"))
                new = text.to_pylist()
                for i in range(batch.num_rows):
                    raw = buf[off[i] : off[i + 1]]
                    if (gone := _spans(batch, i, len(raw), length)) is not None:
                        gone = whole_characters(raw, long_passages(raw, gone, words))
                        new[i] = raw[~gone].tobytes().decode()
                text = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(f"own_{i}") for i, c in enumerate(columns)], columns)

    out = with_spans(docs, spans, columns).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns))
    return out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])).select(*columns) if "n_chars" in columns else out
