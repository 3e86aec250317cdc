"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspring.functions.text import col, tokens

TINY, FLOOR = 1e-15, 1e-12


def doubles(c: Column | str) -> Column:
    return col(c).cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0.0 for different lengths, empty vectors, or a norm next to nothing."""
    a, b = doubles(a), doubles(b)
    bad = (F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norm(a) < TINY) | (norm(b) < TINY)
    return F.when(a.isNull() | b.isNull() | bad, F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f's lambdas name it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normalized(a: Column) -> Column:
    return once(F.struct(a.alias("v"), F.greatest(norm(a), F.lit(FLOOR)).alias("n")), lambda s: F.transform(s["v"], lambda x: x / s["n"]))


def slots(a: Column | str, n: int) -> Column:
    """The vector as n rows of equal width; raises if its length can't be divided."""
    a = doubles(a)
    width = (F.size(a) / n).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(a, i * width + 1, width))
    return F.when(F.size(a) % n != 0, F.raise_error(F.lit(f"the vector can't be cut into {n} slots"))).otherwise(cut)


def maxsim(query: Column, document: Column) -> Column:
    """Sum over the query's rows of the largest cosine with a row of the document; both arrays of rows."""
    both = F.struct(F.transform(query, normalized).alias("q"), F.transform(document, normalized).alias("d"))
    return once(both, lambda s: total(F.transform(s["q"], lambda x: F.array_max(F.transform(s["d"], lambda y: dot(x, y))))))


def hashed_embedding(text: Column | str, size: int = 64) -> Column:
    """A deterministic stand-in for a text model: counts of tokens by hash, normalised."""
    buckets = F.transform(tokens(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % size).cast("int"))
    return once(buckets, lambda held: normalized(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(held, lambda b: b == i)).cast("double"))))
