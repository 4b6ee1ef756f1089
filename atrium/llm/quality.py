"""Quality rules: base counts of a text and a calibrated linear classifier.

The classifier is a logistic regression over hashed word n-grams (1 and 2
words) and hashed character n-grams (4 and 6 bytes).  Each family of features
is the mean over its occurrences in the text, so that a text's score is a mean
of weights, whatever its length.  It is trained on a bounded sample of labelled
rows, its probabilities are calibrated on rows it was not trained on, and it
scores all texts in Arrow batches against a fixed threshold.  Weights are fixed
point integers, hence scores do not depend on how rows fall into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered
from .text import SPACE, Words, column_bytes, doc_slices, window_hashes

#: Hash bits of each family of features.
BITS = 15
FAMILIES = 4
SCALE = 1 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass
class QualityModel:
    """weights: fixed-point, one row for each family; slope and offset turn a score into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * scores + self.offset, -40, 40)))


def _features(w: Words, a: int, b: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For documents a to b: each family's bucket at every position and the positions' document bounds."""
    lo, hi = int(w.of[a]), int(w.of[b])
    words, of = w.hash[lo:hi], w.of[a : b + 1] - lo
    off = w.off[a : b + 1]
    raw = w.buf[off[0] : off[-1]].astype(np.uint64)
    off = off - off[0]
    out = [((words >> np.uint64(64 - BITS)).astype(np.int64), of, 1)]
    out.append(((window_hashes(words, 2) >> np.uint64(64 - BITS)).astype(np.int64), of, 2))
    for k in (4, 6):
        packed = np.zeros(max(0, len(raw) - k + 1), np.uint64)
        for i in range(k):
            packed |= raw[i : i + len(packed)] << np.uint64(8 * i)
        out.append((((packed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64), off, k))
    # a document with m positions has m - k + 1 windows of its own; the others span two documents
    return [(bucket, np.stack([of[:-1], np.maximum(of[:-1], of[1:] - k + 1)])) for bucket, of, k in out]


def _scores(w: Words, model: QualityModel) -> np.ndarray:
    out = np.zeros(len(w.off) - 1)
    for a, b in doc_slices(w.off):
        for weights, (bucket, (start, end)) in zip(model.weights, _features(w, a, b), strict=True):
            total = np.zeros(len(bucket) + 1, np.int64)
            np.cumsum(weights[bucket], out=total[1:])
            end = np.minimum(end, len(bucket))
            start = np.minimum(start, end)
            out[a:b] += (total[end] - total[start]) / np.maximum(end - start, 1) / SCALE
    return out + model.bias


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """The base columns of each document."""
    n = len(w.off) - 1
    cum = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    per_doc = lambda total: total[w.off[1:]] - total[w.off[:-1]]
    chars = per_doc(cum(~SPACE[w.buf] & ((w.buf & 0xC0) != 0x80)))
    symbols = per_doc(cum(_SYMBOL[w.buf]))
    lines, repeated = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        text = w.buf[w.off[i] : w.off[i + 1]].tobytes()
        if text.count(b"\n"):
            full = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
            lines[i] = len(full) - len(set(full))
        h = window_hashes(w.hash[w.of[i] : w.of[i + 1]], 3)
        if len(h) > 1:
            order = np.argsort(h)
            same = h[order[1:]] == h[order[:-1]]
            if same.any():
                hit = np.zeros(len(h) + 2, bool)
                at = np.concatenate([order[1:][same], order[:-1][same]])
                for k in range(3):
                    hit[at + k] = True
                repeated[i] = hit.sum()
    return {"n_words": w.counts(), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeated}


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = Words(*column_bytes(batch.column("text")))
        index, value = [], []
        for i in range(batch.num_rows):
            at, much = [], []
            for f, (bucket, (start, end)) in enumerate(_features(w, i, i + 1)):
                own = bucket[start[0] : min(end[0], len(bucket))]
                k, c = np.unique(own, return_counts=True)
                at.append(k + (f << BITS))
                much.append(c / max(1, len(own)))
            index.append(np.concatenate(at).astype("<i4").tobytes())
            value.append(np.concatenate(much).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["label", "at", "much"])


def _nothing_learnt() -> QualityModel:
    return QualityModel(np.zeros((FAMILIES, 1 << BITS), np.int64), 0.0, 1.0, 40.0)


def _fit(label: np.ndarray, at: list[np.ndarray], much: list[np.ndarray], rounds: int) -> QualityModel:
    """Adaptive gradient descent on two thirds of the rows, row by row within a round; calibration on the others."""
    if len(set(label)) < 2:
        return _nothing_learnt()
    width = FAMILIES << BITS
    train = np.arange(len(label)) % 3 != 0
    if len(set(label[train])) < 2 or len(set(label[~train])) < 2:
        train[:] = True
    share = np.array([np.mean(label[train] == 0), np.mean(label[train] == 1)])
    sample_weight = train * 0.5 / share[label.astype(int)]
    sample_weight /= sample_weight.sum()
    w, b = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    rate = 0.5
    rows = np.flatnonzero(train)
    for t in range(1, rounds + 1):
        g, gb, short = np.zeros(width, np.float32), 0.0, w.astype(np.float32)
        for i in rows:
            z = float(much[i] @ short[at[i]]) + b
            err = sample_weight[i] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[i])
            g[at[i]] += np.float32(err) * much[i]  # a row's buckets are distinct
            gb += err
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * np.square(g, dtype=float)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    fixed = np.round(w * SCALE).astype(np.int64)
    held = np.flatnonzero(~train) if not train.all() else rows
    short = (fixed / SCALE).astype(np.float32)
    z = np.array([float(much[i] @ short[at[i]]) + b for i in held])
    slope, offset = _calibrate(z, label[held])
    return QualityModel(fixed.reshape(FAMILIES, 1 << BITS), float(b), slope, offset)


def _calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Platt scaling: slope and offset of the log odds, with smoothed targets, by Newton steps halved until the loss falls."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    mean, spread = z.mean(), max(z.std(), 1e-9)
    x = (z - mean) / spread

    def loss(a: float, b: float) -> float:
        m = a * x + b
        return float(np.sum(np.logaddexp(0, m) - target * m)) + 0.01 * (a * a + b * b)

    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        r, s = p - target, p * (1 - p)
        step = np.linalg.solve([[(s * x * x).sum() + 0.02, (s * x).sum()], [(s * x).sum(), s.sum() + 0.02]], [(r * x).sum() + 0.02 * a, r.sum() + 0.02 * b])
        size = 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > loss(a, b):
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-8:
            break
    a = max(a, 1e-3)
    return float(a / spread), float(b - a * mean / spread)


def train_quality(documents: DataFrame, labels: DataFrame, rows_per_class: int = 500, rounds: int = 50, seed: int = 17) -> QualityModel:
    """Fit the classifier on labelled rows.

    rows_per_class bounds the training sample: of each class, the labelled rows
    whose seeded hash of doc_id is smallest; of an id's rows that of least text.
    Rows without a doc_id, a label or a text aren't used.  With fewer than two classes every text gets a
    probability near 1.
    """
    sample = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") > 0).cast("int").alias("label")).groupBy("doc_id").agg(F.min("label").alias("label"))
    order = F.xxhash64(F.col("doc_id"), F.lit(seed)), F.col("doc_id")
    picked = None
    for label in (0, 1):  # at most rows_per_class ids of each class reach the driver
        part = sample.where(F.col("label") == label).orderBy(*order).limit(rows_per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    features = texts.select("label", "doc_id", "text").mapInArrow(_with_key, "label int, doc_id long, at binary, much binary")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, at, much = [], [], []
        for batch in batches:
            for y, a, v in zip(batch.column("label").to_pylist(), batch.column("at"), batch.column("much"), strict=True):
                if len(a.as_buffer()):
                    label.append(y)
                    at.append(np.frombuffer(a.as_buffer(), "<i4"))
                    much.append(np.frombuffer(v.as_buffer(), "<f4"))
        m = _fit(np.array(label, float), at, much, rounds)
        yield pa.RecordBatch.from_pydict({"weights": pa.array([m.weights.tobytes()], pa.binary()), "bias": [m.bias], "slope": [m.slope], "offset": [m.offset]})

    # the bounded sample meets in one task, and the model, of fixed size, reaches the driver
    model = features.repartition(1).sortWithinPartitions("doc_id").mapInArrow(fit, "weights binary, bias double, slope double, offset double").head()
    if model is None:
        return _nothing_learnt()
    return QualityModel(np.frombuffer(model.weights, np.int64).reshape(FAMILIES, 1 << BITS), model.bias, model.slope, model.offset)


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for out in _sample_features(iter([batch])):
            yield pa.RecordBatch.from_arrays([out.column("label"), batch.column("doc_id"), out.column("at"), out.column("much")], ["label", "doc_id", "at", "much"])


def quality_rules(documents: DataFrame, model: QualityModel, threshold: float = 0.5, passthrough: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``passthrough`` columns, base counts, base_failed, probability and kept.

    A null or empty text has no words and fails the base rule (fewer than 50
    words); repeated rows get equal verdicts; further columns are ignored.  A
    text is kept if the base rule passes and its calibrated probability of
    good quality reaches ``threshold``.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column_bytes(batch.column("__text"))
            for i, j in doc_slices(off, 1 << 19):
                w = Words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                counts = base_counts(w)
                failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
                p = model.probability(_scores(w, model))
                own = [batch.column(c).slice(i, j - i) for c in passthrough]
                arrays = [*own, *(pa.array(counts[n], pa.int64()) for n in names), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
                yield pa.RecordBatch.from_arrays(arrays, [*passthrough, *names, "base_failed", "probability", "kept"])

    kinds = dict(documents.dtypes)
    own = ", ".join(f"`{c}` {kinds[c]}" for c in passthrough)
    return documents.select(*passthrough, F.col("text").alias("__text")).mapInArrow(judge, f"{own}, {COUNTS}, base_failed boolean, probability double, kept boolean")


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, with the columns of docs, whatever their names.

    A null or empty text goes (it has no words), repeated rows share a verdict,
    a null id or source changes nothing, an empty table stays empty.
    """
    model = train_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = numbered(docs)
    judged = quality_rules(own.withColumn("text", F.col(own.columns[docs.columns.index("text")])), model, passthrough=tuple(own.columns))
    return judged.where("kept").select(*own.columns).toDF(*docs.columns)
