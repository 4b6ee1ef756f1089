"""Vectors of texts without a model: signed hashing of character n-grams, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector import mean_vectors, norm, normalize


def grams(text: Column, n: int = 3) -> Column:
    """The runs of n characters of a text in lower case, with a space before and after; a null text is empty, and one too short for a run is its own."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    runs = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(F.length(padded) < n, F.array(padded)).otherwise(runs)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, wherever it is used; outside a lambda it would be computed at each place."""
    return F.transform(F.array(value), use)[0]


def text_vector(text: Column, dims: int = 64, n: int = 3) -> Column:
    """Unit vector of a text: each gram adds 1 or -1, by its hash, at a place of its hash.

    The hash is the first eight hexadecimal digits of the gram's MD5; its
    remainder by ``dims`` is the place, and an odd quotient means -1.  Where
    signs cancel to nothing, the vector is all zeros.
    """
    hashes = F.transform(grams(text, n), lambda g: F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long"))
    signed = F.transform(hashes, lambda h: F.struct((h % dims).alias("pos"), F.when(F.floor(h / dims) % 2 == 1, -1.0).otherwise(1.0).alias("sign")))
    total = lambda s, d: F.aggregate(F.filter(s, lambda g: g["pos"] == d), F.lit(0.0), lambda t, g: t + g["sign"])
    sums = _once(signed, lambda s: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: total(s, d)))
    return _once(sums, lambda v: _once(norm(v), lambda size: F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)))


def template_vectors(names: DataFrame, templates: DataFrame, name: str = "name", dims: int = 64, n: int = 3) -> DataFrame:
    """name and vector: the normalised mean of the vectors of all templates filled with a name.

    templates: one column, template, with % for the name; names repeat without
    effect.  Every name meets every template, a small set that the caller states.
    """
    filled = names.select(name).distinct().crossJoin(templates).withColumn("prompt", F.replace(F.col("template"), F.lit("%"), F.coalesce(F.col(name), F.lit(""))))
    vectors = filled.select(name, text_vector(F.col("prompt"), dims, n).alias("vector"))
    return mean_vectors(vectors, [name], "vector", "mean").select(name, normalize(F.col("mean")).alias("vector"))
