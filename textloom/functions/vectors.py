"""Column expressions over dense vectors (arrays of floats)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def fit_dimension(v: Column, n: int) -> Column:
    """Cut off or padded with zeros to ``n`` entries."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def recency(similarity: Column, ts: Column, as_of: str, rate: float = 0.002) -> Column:
    """Similarity times exp(-rate x age in days); unknown time: as it is; a future time: age 0."""
    age = F.greatest((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86400e6, F.lit(0.0))
    return F.when(ts.isNull(), similarity).otherwise(similarity * F.exp(-rate * age))


def hashed_words(text: Column, n: int) -> Column:
    """A deterministic stand-in for a model: how many lower-case words of the text fall into each of ``n`` buckets by their MD5. Null counts as empty."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))
    buckets = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % n)
    return T.let(buckets, lambda found: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.size(F.filter(found, lambda b: b == i)).cast("float")))
