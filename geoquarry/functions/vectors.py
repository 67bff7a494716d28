"""Vector columns over ``array<double>``."""

from pyspark.sql import functions as F


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a):
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def unit(a):
    """The vector over its length; a zero vector stays zero."""
    length = norm(a)
    return F.transform(a, lambda v: v / F.when(length == 0, F.lit(1.0)).otherwise(length))


def cosine(a, b):
    """Cosine with zero lengths counted as one."""
    na, nb = norm(a), norm(b)
    one = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return dot(a, b) / (one(na) * one(nb))
