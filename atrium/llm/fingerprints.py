"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, phrases into phrases of phrases, and so
on.  On each level, runs of one symbol become one symbol; deterministic coin
tossing gives each symbol a label of less than 6 from itself and its left
neighbours; a phrase starts at each local minimum of the labels; and a phrase's
name is a hash of its symbols.  Where a phrase starts depends on a few symbols
around it, so equal substrings share the names of their interior at any offset.
A fingerprint holds, for each level, a sketch of the level's names: the least
hash in each of 32 bins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SLICE, doc_slices, mix, powers

LEVELS, BINS = 4, 32
#: A level speaks for two texts if both have so many phrases on it.
ENOUGH = 12
_NAMES = mix(np.arange(1, 257, dtype=np.uint64))
_LOW8 = np.array([0] + [(i & -i).bit_length() - 1 for i in range(1, 256)], np.uint8)


def _runs(sym: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal symbols; edge: first symbol of each document."""
    start = np.empty(len(sym), bool)
    start[:1] = True
    start[1:] = sym[1:] != sym[:-1]
    start[edge] = True
    at = np.flatnonzero(start)
    return at, np.diff(np.append(at, len(sym)))


def _toss(sym: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """One round: 2 * (lowest bit in which a symbol differs from the one before) + that bit."""
    diff = np.empty_like(sym)
    diff[1:] = sym[1:] ^ sym[:-1]
    diff[edge] = 1
    if sym.dtype == np.uint8:
        low = _LOW8[diff]
        return low * np.uint8(2) + ((sym >> low) & np.uint8(1))
    one = np.uint64(1)
    low = np.bitwise_count((diff & (~diff + one)) - one)
    return (low * np.uint8(2) + ((sym >> low.astype(np.uint64)) & one).astype(np.uint8)).astype(np.uint8)


def parse_level(sym: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases of each document; of: bounds of the documents' symbols (n + 1)."""
    edge = of[:-1][of[:-1] < of[1:]]
    at, length = _runs(sym, edge)
    of = np.searchsorted(at, of)
    edge = of[:-1][of[:-1] < of[1:]]
    short = sym[at]
    label = _toss(short, edge)
    for _ in range(3):
        label = _toss(label, edge)
    low = np.ones(len(short), bool)
    if len(short) > 1:
        low[1:] = label[1:] < label[:-1]
        low[1:-1] &= label[1:-1] < label[2:]
        low[-1] = False
    last = of[1:][of[:-1] < of[1:]] - 1
    low[last] = False  # the last symbol has no right neighbour
    low[edge] = True
    start = np.flatnonzero(low)
    names = (_NAMES[short] if sym.dtype == np.uint8 else short) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(len(names) + 1, np.uint64)
    up, down = powers(len(names) + 1)
    np.cumsum(mix(names) * up[: len(names)], out=total[1:])
    end = np.append(start[1:], len(names))
    return mix((total[end] - total[start]) * down[start]), np.searchsorted(start, of)


def _sketch(names: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each document: saturated count of names, then the least 16 hash bits of each bin (0xFFFF: none)."""
    n = len(of) - 1
    out = np.full((n, BINS + 1), 0xFFFF, np.uint16)
    doc = np.repeat(np.arange(n), np.diff(of))
    value = np.minimum((names >> np.uint64(16)) & np.uint64(0xFFFF), np.uint64(0xFFFE)).astype(np.uint16)
    np.minimum.at(out.ravel(), doc * (BINS + 1) + 1 + (names >> np.uint64(59)).astype(np.int64), value)
    out[:, 0] = np.minimum(np.diff(of), 0xFFFF)
    return out


def sketches(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sketches of all texts of a buffer: (texts, LEVELS, BINS + 1)."""
    out = np.empty((len(off) - 1, LEVELS, BINS + 1), np.uint16)
    for i, j in doc_slices(off):
        sym, of = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        for level in range(LEVELS):
            sym, of = parse_level(sym, of)
            out[i:j, level] = _sketch(sym, of)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of two arrays of sketches: shared bins on the highest level with enough phrases in both."""
    n = len(a)
    count = np.minimum(a[:, :, 0], b[:, :, 0])
    level = np.where(count >= ENOUGH, np.arange(LEVELS), 0).max(1, initial=0)
    x, y = a[np.arange(n), level, 1:], b[np.arange(n), level, 1:]
    used = (x != 0xFFFF) | (y != 0xFFFF)
    same = ((x == y) & used).sum(1) / np.maximum(used.sum(1), 1)
    return np.where(used.any(1), same, 1.0)


def fingerprint_string(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=off[1:])
    return np.frombuffer(b"".join(texts), np.uint8), off


def edited(text: str, following: str) -> str:
    """The last quarter of text replaced by as many first code points of the next text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _ranges(cuts: list[int]) -> Column:
    """The number of the range of (key, th) that a row lies in, in their order.

    cuts: quantiles of key.  One that occurs m times is a key of very many rows:
    these are cut into m ranges by th, a hash, and come before the keys above it.
    """
    values = sorted(set(cuts))
    if not values:
        return F.lit(0)
    many = [cuts.count(v) for v in values]
    first = [1]
    for m in many:
        first.append(first[-1] + (m + 1 if m > 1 else 1))
    # the last cut that isn't above the key, in two steps of at most 64 or so comparisons each
    low = lambda array: F.size(F.filter(array, lambda c: c <= F.col("key")))
    array = lambda x: F.array(*map(F.lit, x))
    step = max(1, round(len(values) ** 0.5))
    block = low(array(values[::step]))
    at = F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + low(F.slice(array(values), (block - 1) * step + 1, F.lit(step))))
    pick = lambda x: F.element_at(array(x), at)
    share = F.least(F.floor((F.col("th") / F.lit(2.0**64) + 0.5) * pick(many)).cast("int"), pick(many) - 1)
    own = F.when(pick(many) == 1, 0).when(F.col("key") == pick(values), share).otherwise(pick(many))
    return F.when(at == 0, F.lit(0)).otherwise(pick(first[:-1]) + own)


def _in_order(documents: DataFrame, parts: int) -> DataFrame:
    """The documents by range of (doc_id, hash of the text), each range followed by the first document of the next (tail = 1)."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select(key.alias("key"), F.xxhash64(text).alias("th"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    cuts = docs.select(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 10000)).head()[0] or []
    bucket = _ranges(list(cuts)).cast("int")
    # one row a range reaches the driver
    firsts = sorted((r.bucket, r.head.key, r.head.th) for r in docs.groupBy(bucket.alias("bucket")).agg(F.min(F.struct("key", "th")).alias("head")).collect())
    rows = docs.select(bucket.alias("bucket"), F.lit(0).alias("tail"), "key", "th", "doc_id", "text")
    if firsts:
        before = spark_rows(documents, [(firsts[i - 1][0], k, t) for i, (_, k, t) in enumerate(firsts)])
        # one row of 20 bytes a range, whose number the session's partitions bound
        heads = docs.join(F.broadcast(before), ["key", "th"]).dropDuplicates(["bucket"])
        rows = rows.unionByName(heads.select("bucket", F.lit(1).alias("tail"), "key", "th", "doc_id", "text"))
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", "key", "th", "text")


def spark_rows(like: DataFrame, rows: list[tuple]) -> DataFrame:
    """bucket, key, th: a small table, one row a range."""
    return like.sparkSession.createDataFrame(rows, "bucket int, key long, th long")


def fingerprint_documents(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  The next document is the one of the next larger
    doc_id, after the last one the first; rows of equal doc_id follow each other
    by a hash of their text, a null doc_id comes first.  A null text is empty; empty texts are
    like each other and unlike any other.  Further columns are ignored.
    """
    spark = documents.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the document that waits for its next one: bucket, doc_id, text
        ready: list[tuple] = []  # doc_id, text, next text
        size, done = 0, None  # done: a bucket whose tail has been seen
        for batch in batches:
            for bucket, tail, doc, text in zip(batch.column("bucket").to_pylist(), batch.column("tail").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if tail and done == bucket:
                    continue
                text = text.as_py()
                if held is not None and held[0] == bucket:
                    ready.append((held[1], held[2], text))
                    size += len(held[2])
                if tail:
                    held, done = None, bucket
                else:
                    held = (bucket, doc, text)
                if size > SLICE or len(ready) >= 2000:
                    yield _rows(ready)
                    ready, size = [], 0
        if ready:
            yield _rows(ready)

    return _in_order(documents, parts).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _rows(ready: list[tuple]) -> pa.RecordBatch:
    own = [t.encode() for _, t, _ in ready]
    new = [edited(t, x).encode() for _, t, x in ready]
    own_s, new_s = sketches(*_pack(own)), sketches(*_pack(new))
    # a document's next text is mostly the next row; the others are parsed here
    odd = [i for i in range(len(ready)) if i + 1 == len(ready) or ready[i][2] is not ready[i + 1][1]]
    next_s = np.concatenate([own_s[1:], own_s[:1]])
    next_s[odd] = sketches(*_pack([ready[i][2].encode() for i in odd]))
    return pa.RecordBatch.from_arrays([
        pa.array([d for d, _, _ in ready], pa.int64()), pa.array([len(t) for _, t, _ in ready], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in new]),
        pa.array(map(fingerprint_string, own_s), pa.string()), pa.array(map(fingerprint_string, new_s), pa.string()), pa.array(likeness(own_s, new_s)), pa.array(likeness(own_s, next_s)),
    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
