"""Repeated passages of words: windows that also start in an earlier document, found from winnowed anchors.

1. Every text is cut into runs: the windows that share one anchor (see
   anchors.py) start at consecutive places.  A run is dealt by its anchor's
   gram, with a hash of all the text its windows cover.
2. Runs that cover the same text are a class.  Windows of a class with a partner
   are repeats at once, however many members it has; one member stands for it.
3. Classes of one anchor gram that cover different text may still share some
   windows, where texts agree around the anchor but not as far as both runs
   reach.  A shared window holds either many words before its anchor or many from
   it on, so of words only classes are compared that have one of both sides in
   common with another class; most short grams meet by chance, and ever more of
   them in larger tables.  Their matches are extended from the anchor both ways, word by word
   (extension.py): forwards as common prefixes of the sorted texts, backwards as
   long as texts agree.  Grams with very many classes are dealt out by window
   instead, so that no task gets them whole.
   The class's other runs in its least document then get what was found for the
   one that stands.
   Grams and classes that are frequent in a sample are known beforehand, so that
   no task gets all their runs: a run of a frequent class is a repeat at once if
   an earlier member is in the sample, and other runs of a frequent gram are
   dealt by class.  The sample decides where runs go, never what they are.
4. A document's repeated windows, merged, are its maximal repeats.

Words count as equal if their 64-bit hashes are, classes if those of anchor gram
and text are.  suffixes.py does steps 1 and 2 for bytes as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .anchors import anchor_runs
from .common import stored
from .extension import by_key, common_prefixes, extend_back, stretches
from .text import _TABLE, SLICE, Words, column_bytes, doc_slices, mix, powers

#: Symbols that one numpy pass over a very long text handles.
PIECE = 1 << 18
#: Bytes of word hashes after anchors that one pass of the extension holds.
CHUNK = 2 << 20

_LEAST = -(1 << 63)


def place_columns() -> list:
    """first, count and low of a run, unpacked from pos."""
    part = lambda by, bits: F.shiftright("pos", by).bitwiseAND(F.lit((1 << bits) - 1))
    return [part(0, 31).alias("first"), part(31, 11).alias("count"), part(42, 11).alias("low")]


def keyed(documents: DataFrame, *columns) -> DataFrame:
    """doc: the id, a null as the least long; h: a hash that tells apart texts of the same id; text; further columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"), *columns)


class Symbols:
    """The symbols of a batch of texts as 64-bit hashes: its bytes, or its words."""

    def __init__(self, kind: str, buf: np.ndarray, off: np.ndarray):
        if kind == "bytes":
            self.raw, self.of = buf, off
        else:
            words = Words(buf, off)
            self.raw, self.of = words.hash, words.of

    def hashes(self, a: int, b: int) -> np.ndarray:
        return _TABLE[self.raw[a:b]] if self.raw.dtype == np.uint8 else self.raw[a:b]

    def pieces(self, window: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
        """(hashes, bounds, ends, first document, place of the first symbol in its document).

        Each window starts in one piece, within its bounds; ends: how far the
        hashes go for each document, up to ``reach`` symbols from any window.
        """
        for i, j in doc_slices(self.of, PIECE):
            a, b = int(self.of[i]), int(self.of[j])
            if b - a <= 2 * PIECE:
                bounds = self.of[i : j + 1] - a
                yield self.hashes(a, b), bounds, bounds[1:], i, 0
                continue
            for s in range(a, b, PIECE):
                e = min(b, s + PIECE + reach - 1)
                yield self.hashes(s, e), np.array([0, min(e, s + PIECE + window - 1) - s]), np.array([e - s]), i, s - a


def prefix(sym: np.ndarray) -> np.ndarray:
    total = np.zeros(len(sym) + 1, np.uint64)
    np.cumsum(sym * powers(len(sym) + 1)[0][: len(sym)], out=total[1:])
    return total


def span(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * powers(len(total))[1][start])


class Frequent:
    """Grams and classes with at least ``least`` runs in a sample of documents; of a class its first member there."""

    def __init__(self, rows: list, earlier: bool):
        self.earlier = earlier
        column = lambda name: np.array([r[name] for r in rows], np.int64)
        self.keys = np.unique(column("key")).view(np.uint64)
        self.keys.sort()
        key, full = column("key").view(np.uint64), column("full").view(np.uint64)
        order = np.argsort(mix(key) ^ full)
        self.key, self.full, self.doc, self.h, self.pos = key[order], full[order], column("doc")[order], column("h")[order], column("pos")[order]
        self.mark, self.n = (mix(key) ^ full)[order], column("n")[order]

    def place(self, key: np.ndarray, full: np.ndarray, doc: np.ndarray, h: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each run: what it is dealt by, its gram if that differs (else 0), and its state (see _runs)."""
        zero = np.zeros(len(key), np.int64)
        if not len(self.keys):
            return key, zero, zero
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        often = self.keys[i] == key
        if not often.any():
            return key, zero, zero
        i = np.minimum(np.searchsorted(self.mark, mix(key) ^ full), len(self.mark) - 1)
        known = often & (self.key[i] == key) & (self.full[i] == full) & (self.n[i] > 1)
        after = (h > self.h[i]) | ((h == self.h[i]) & (pos > self.pos[i]))
        later = known & ((doc > self.doc[i]) if self.earlier else (doc > self.doc[i]) | ((doc == self.doc[i]) & after))
        by_class, by_run = mix(mix(key) ^ full), mix(key ^ mix((doc ^ h).view(np.uint64)) ^ pos.view(np.uint64))
        deal = np.where(later, by_run, np.where(often, by_class, key))
        state = np.where(later, 3, np.where(known, 2, np.where(often, 1, 0)))
        return deal, np.where(often, key.view(np.int64), 0), state


def _frequent(documents: DataFrame, kind: str, window: int, gram: int, earlier: bool, reach: int, sample: int, least: int, most: int) -> Frequent:
    """From about ``sample`` documents; at most ``most`` classes reach the driver."""
    step = max(1, documents.count() // sample)
    picked = documents.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(step)) == 0)
    classes = _runs(picked, kind, window, gram, reach, None).groupBy(F.col("deal").alias("key"), "full").agg(F.count("*").alias("n"), F.min(F.struct("doc", "h", "pos")).alias("head"))
    grams = classes.groupBy("key").agg(F.sum("n").alias("runs")).where(F.col("runs") >= least).orderBy(F.desc("runs"), "key").limit(most // 8)
    rows = classes.join(F.broadcast(grams.select("key")), "key").orderBy(F.desc("n"), "key", "full").limit(most).select("key", "full", "n", "head.doc", "head.h", "head.pos").collect()
    return Frequent(rows, earlier)


def _runs(documents: DataFrame, kind: str, window: int, gram: int, reach: int, frequent: Frequent | None, back: int = 0) -> DataFrame:
    """deal, gram, full, doc, h, pos, state of each run, and left and right if ``back``.

    left: a hash of the text from ``back`` symbols before the anchor to its
    gram's end, null if all windows start later; right: of what a window that
    starts later holds from the anchor on at least, null if none does.

    full is a hash of the text from the first window to ``reach`` symbols from
    the last one's start.  pos packs low, the symbols from the last window's
    start to the anchor (11 bits), the run's windows (11) and its first window
    (31).  A run is dealt by its anchor's gram.  state: 1, of a frequent gram, dealt by
    class; 2, of a frequent class, likewise; 3, of a frequent class and later
    than its first member in the sample, dealt by itself.
    """
    shared = documents.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            docs, hs = batch.column("doc").to_numpy(), batch.column("h").to_numpy()
            buf, off = column_bytes(batch.column("text"))
            for i, j in doc_slices(off, 2 * SLICE):
                symbols = Symbols(kind, buf[off[i] : off[j]], off[i : j + 1] - off[i])
                for sym, of, ends, base, shift in symbols.pieces(window, reach):
                    if of[-1] < window:
                        continue
                    total = prefix(sym)
                    at = np.arange(of[-1] - gram + 1)
                    grams = span(total, at, at + gram)
                    d, anchor, first, count = anchor_runs(grams, of, window, gram)
                    key, full = grams[anchor], span(total, first, np.minimum(first + count + reach - 1, ends[d]))
                    doc, h = docs[i + base + d], hs[i + base + d]
                    pos = ((anchor - first - count + 1) << 42) | (count << 31) | (first - of[d] + shift)
                    zero = np.zeros(len(key), np.int64)
                    deal, own, state = (key, zero, zero) if often is None else often.place(key, full, doc, h, pos)
                    sides = []
                    if back:
                        wide, near = anchor - first >= back, anchor - first - count + 1 < back
                        left = span(total, np.where(wide, anchor - back, anchor), anchor + gram)
                        right = span(total, anchor, np.where(near, anchor + window - back + 1, anchor))
                        sides = [pa.array((x >> np.uint64(32)).astype(np.uint32).view(np.int32), mask=~there) for x, there in ((left, wide), (right, near))]
                    yield pa.RecordBatch.from_arrays([pa.array(deal.view(np.int64)), pa.array(own), pa.array(full.view(np.int64)), pa.array(doc), pa.array(h), pa.array(pos), pa.array(state.astype(np.int32)), *sides], ["deal", "gram", "full", "doc", "h", "pos", "state", *(["left", "right"] if back else [])])

    return keyed(documents).mapInArrow(run, "deal long, gram long, full long, doc long, h long, pos long, state int" + (", left int, right int" if back else ""))


def texts_of(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """doc, h, text and the arrays first, count, low and key of the given runs, once for each doc and h."""
    wanted = runs.groupBy("doc", "h").agg(F.sort_array(F.collect_list(F.struct("first", "count", "low", "key"))).alias("runs"))
    found = keyed(documents).join(wanted, ["doc", "h"])
    if not keyed(documents).groupBy("doc", "h").count().where("count > 1").isEmpty():
        found = found.dropDuplicates(["doc", "h"])
    return found.select("doc", "h", "text", *[F.col(f"runs.{c}").alias(c) for c in ("first", "count", "low", "key")])


def _around(documents: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """key, doc, h, run (its first window), low, back and ahead: hashes of the words before a run's anchor and from it on, as far as its windows reach."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column_bytes(batch.column("text"))
            for i in range(batch.num_rows):
                first, count, low, key = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("first", "count", "low", "key"))
                raw = Words(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]])).hash.tobytes()
                at = 8 * (first + count - 1 + low)
                back = [raw[a:b] for a, b in zip((8 * first).tolist(), at.tolist(), strict=True)]
                ahead = [raw[a:b] for a, b in zip(at.tolist(), (8 * (first + count - 1 + window)).tolist(), strict=True)]
                own = [pa.array(np.full(len(first), batch.column(c)[i].as_py(), np.int64)) for c in ("doc", "h")]
                yield pa.RecordBatch.from_arrays([pa.array(key), *own, pa.array(first), pa.array(low), pa.array(back, pa.binary()), pa.array(ahead, pa.binary())], ["key", "doc", "h", "run", "low", "back", "ahead"])

    return texts_of(documents, runs).mapInArrow(cut, "key long, doc long, h long, run long, low long, back binary, ahead binary")


def _extended(rows: DataFrame, window: int) -> DataFrame:
    """doc, h, run (its first window), first, last: stretches of windows that a smaller doc has too, among the given runs, by key."""

    def judge(table: pa.Table) -> pa.RecordBatch:
        key, doc, h, run, low = (table.column(c).to_numpy() for c in ("key", "doc", "h", "run", "low"))
        raw, off = column_bytes(table.column("back"))
        size = np.diff(off) // 8
        hit = np.zeros((len(doc), int(size.max(initial=0)) + 1), bool)

        def report(d: int, order: np.ndarray, same: np.ndarray, lcp: np.ndarray) -> None:
            # neighbours that share a whole window at this distance form a block; runs that end before it share too little
            head = np.flatnonzero(np.append(True, ~(same & (lcp[1:] + d >= window))))
            own = doc[order]
            least = np.repeat(np.minimum.reduceat(own, head), np.diff(np.append(head, len(order))))
            hit[order[(own > least) & (low[order] <= d)], d] = True

        group = np.cumsum(np.append(False, key[1:] != key[:-1]))
        extend_back(group, np.frombuffer(raw.tobytes(), np.uint64), off // 8, common_prefixes(*column_bytes(table.column("ahead"))) // 8, report)
        row, near, far = stretches(hit)
        at = run + size
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(h[row]), pa.array(run[row]), pa.array(at[row] - far), pa.array(at[row] - near)], ["doc", "h", "run", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "ahead", CHUNK):
            if len(table) > 1:
                yield judge(table)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", "ahead").mapInArrow(run, "doc long, h long, run long, first long, last long")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """window (a hash), doc, h, run, first: a row for each window of the given runs."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc, h, run, low, back, ahead in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "h", "run", "low", "back", "ahead")), strict=True):
                total = prefix(np.frombuffer(back + ahead, np.uint64))
                start = np.arange(len(back) // 8 - low + 1)
                own = mix(span(total, start, start + window) ^ np.uint64(key & (1 << 64) - 1)).view(np.int64)
                same = [pa.array(np.full(len(start), x, np.int64)) for x in (doc, h, run)]
                yield pa.RecordBatch.from_arrays([pa.array(own), *same, pa.array(start + run)], ["window", "doc", "h", "run", "first"])

    return rows.mapInArrow(hashes, "window long, doc long, h long, run long, first long")


def find_classes(documents: DataFrame, kind: str, window: int, gram: int, earlier: bool, reach: int, sample: int = 4000, least: int = 8, most_frequent: int = 65536) -> DataFrame:
    """key, doc, h, first, count, low, repeat, stands, lead_h, lead_pos of the runs that may hold repeated windows, as a stored table.

    kind: "words" or "bytes".  earlier: a window repeats if it also starts in a
    document of smaller id; else if it also starts anywhere else.  sample, least
    and most_frequent bound what is known beforehand (see _frequent).
    """
    if window - gram >= 2048:
        raise ValueError("runs hold up to 2048 windows: take a longer gram")
    frequent = _frequent(documents, kind, window, gram, earlier, reach, sample, least, most_frequent)
    by_deal, by_class = W.partitionBy("deal"), W.partitionBy("deal", "full")
    back = (window - gram) // 2 if kind == "words" else 0
    runs = _runs(documents, kind, window, gram, reach, frequent, back).withColumn("n", F.count("*").over(by_deal)).withColumn("lowest", F.min("full").over(by_deal)).withColumn("highest", F.max("full").over(by_deal)).where("n > 1 or state > 0")
    order = by_class.orderBy("doc", "h", "pos")
    runs = runs.withColumn("rank", F.row_number().over(order)).withColumn("lead", F.first("doc").over(order)).withColumn("after", F.lead("doc").over(order))
    # a frequent class's first member in the sample is dealt by class, with all that are earlier still
    within = (F.col("doc") > F.col("lead")) if earlier else (F.col("rank") > 1) | F.col("after").isNotNull() | (F.col("state") == 2)
    repeat = (F.col("state") == 3) | within
    alike = F.col("lowest") != F.col("highest")
    if back:
        # runs of one class have equal sides; those of frequent grams don't meet here and are all compared
        met = [W.partitionBy("deal", side) for side in ("left", "right")]
        shared = [F.col(side).isNotNull() & (F.min("full").over(w) != F.max("full").over(w)) for side, w in zip(("left", "right"), met, strict=True)]
        runs = runs.withColumn("shared_left", shared[0]).withColumn("shared_right", shared[1])
        alike = F.col("shared_left") | F.col("shared_right")
    compared = alike | (F.col("state") > 0)
    stands = (F.col("state") != 3) & (F.col("rank") == 1) & compared
    # a class's other runs in its least document don't repeat its first one, but what that shares with other classes they share too
    led = ~repeat & (F.col("rank") > 1) & compared
    leader = [F.when(led, F.first(c).over(order)) if earlier else F.lit(None).cast("long") for c in ("h", "pos")]
    key = F.when(F.col("gram") != 0, F.col("gram")).otherwise(F.col("deal"))
    found = runs.select(key.alias("key"), "doc", "h", *place_columns(), repeat.alias("repeat"), stands.alias("stands"), leader[0].alias("lead_h"), leader[1].alias("lead_pos"))
    return stored(found.where("repeat or stands or lead_pos is not null"), "runs")


def many_classes(open_runs: DataFrame, most: int) -> DataFrame | None:
    """The keys with more than ``most`` classes, as a stored table; None if there are none."""
    hot = stored(open_runs.groupBy("key").agg(F.count("*").alias("classes")).where(F.col("classes") > most).select("key"), "hot")
    return None if hot.isEmpty() else hot


def find_repeats(documents: DataFrame, window: int, gram: int, most_classes: int = 20000, **sampling) -> DataFrame:
    """doc, h and spans (array of first and last window start) of all documents with windows of words that an earlier document has.

    Grams with more than ``most_classes`` classes are compared window by window.
    """
    found = find_classes(documents, "words", window, gram, True, window, **sampling)
    # a class that repeats as a whole still stands for it where others of its gram are compared with it
    open_runs = found.where("stands").select("key", "doc", "h", "first", "count", "low")
    hot = many_classes(open_runs, most_classes)
    hits = None
    if hot is not None:
        hits = _by_window(_windows(_around(documents, open_runs.join(hot, "key", "left_semi"), window), window))
        open_runs = open_runs.join(hot, "key", "left_anti")
    alike = _extended(_around(documents, open_runs, window), window)
    hits = stored(alike if hits is None else hits.unionByName(alike), "hits")
    led = found.where("lead_pos is not null").select("doc", F.col("h").alias("own_h"), F.col("first").alias("own"), F.col("lead_h").alias("h"), F.col("lead_pos").bitwiseAND(F.lit((1 << 31) - 1)).alias("run"))
    ahead = F.col("own") - F.col("run")
    out = found.where("repeat").select("doc", "h", "first", (F.col("first") + F.col("count") - 1).alias("last"))
    out = out.unionByName(led.join(hits, ["doc", "h", "run"]).select("doc", F.col("own_h").alias("h"), (F.col("first") + ahead).alias("first"), (F.col("last") + ahead).alias("last")))
    out = out.unionByName(hits.drop("run"))
    return out.groupBy("doc", "h").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def _by_window(windows: DataFrame) -> DataFrame:
    """The comparison as a join on window hashes, pre-aggregated, for grams with very many classes."""
    table = stored(windows, "windows")
    least = table.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("window", "least")
    return table.join(least, "window").where("doc > least").select("doc", "h", "run", "first", F.col("first").alias("last"))


def with_spans(documents: DataFrame, spans: DataFrame, columns: list[str]) -> DataFrame:
    """own_0, own_1, ... (the given columns), text (never null) and the arrays of each field of spans, null for documents without any."""
    fields = spans.schema["spans"].dataType.elementType.names
    joined = keyed(documents, *[F.col(c).alias(f"own_{i}") for i, c in enumerate(columns)]).join(spans, ["doc", "h"], "left")
    return joined.select(*[f"own_{i}" for i in range(len(columns))], "text", *[F.col(f"spans.{f}").alias(f) for f in fields])


def covered(n: int, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Which of n symbols the windows from first to last cover."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, last + window, -1)
    return np.cumsum(step[:n]) > 0


def _bounds(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray] | None:
    if not batch.column("first")[i].is_valid:
        return None
    return batch.column("first")[i].values.to_numpy(), batch.column("last")[i].values.to_numpy()


def remove_earlier_words(documents: DataFrame, window: int = 13, gram: int = 3, most_classes: int = 20000, texts: bool = False, **sampling) -> DataFrame:
    """Substring dedup by words: drop each word covered by a window that also starts in a document of smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by
    a space) and, if ``texts``, kept_text.  A null or empty text has no words;
    rows repeated under one id don't count against each other; a null id is the
    smallest.  Further columns are ignored.
    """
    spans = find_repeats(documents, window, gram, most_classes, **sampling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column_bytes(batch.column("text"))
            n, removed, digest, kept_text = [], [], [], []
            for i in range(batch.num_rows):
                words = buf[off[i] : off[i + 1]].tobytes().split()
                n.append(len(words))
                if (bounds := _bounds(batch, i)) is not None:
                    gone = covered(len(words), *bounds, window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(n[-1] - len(words))
                kept = b" ".join(words)
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode() if texts else None)
            yield pa.RecordBatch.from_arrays([batch.column("own_0"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), *([pa.array(kept_text, pa.string())] if texts else [])], ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if texts else [])])

    return with_spans(documents, spans, ["doc_id"]).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else ""))
