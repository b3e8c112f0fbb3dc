"""Vector arithmetic on arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-10) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def unit(a: Column, eps: float = 1e-10) -> Column:
    """The vector over its length; the length is computed once."""
    return F.transform(F.array(F.struct(a.alias("v"), F.greatest(norm(a), F.lit(eps)).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"])).getItem(0)


def softmax(a: Column) -> Column:
    shifted = F.transform(F.array(F.array_max(a)), lambda m: F.transform(a, lambda x: F.exp(x - m))).getItem(0)
    return F.transform(F.array(shifted), lambda e: F.transform(F.array(total(e)), lambda t: F.transform(e, lambda x: x / t)).getItem(0)).getItem(0)
