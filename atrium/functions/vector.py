"""Vector expressions over array columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_doubles(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Left fold in index order, so that results agree with a sequential dot product bit for bit."""
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def normalize(v: Column | str) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_doubles(v), lambda x: x / n)).otherwise(as_doubles(v))


def without_nan(v: Column | str) -> Column:
    return F.transform(as_doubles(v), lambda x: F.when(F.isnan(x), 0.0).otherwise(x))


def blend(a: Column | str, b: Column | str, weight: float) -> Column:
    """Normalised weight * a + (1 - weight) * b."""
    return normalize(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: weight * x + (1 - weight) * y))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "mean_vector", extra: tuple[Column, ...] = ()) -> DataFrame:
    """Element-wise mean by keys: one partial sum for each key and element, whatever the group's size."""
    parts = df.select(*keys, F.posexplode(as_doubles(vector)).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("v"))
    means = parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias(out))
    if not extra:
        return means
    return means.join(df.groupBy(*keys).agg(*extra), keys)


def softmax_over(score: Column | str, *partition: str) -> Column:
    """exp(score - max) normalised within the partition."""
    w = W.partitionBy(*partition)
    e = F.exp(_c(score) - F.max(_c(score)).over(w))
    return e / F.sum(e).over(w)
