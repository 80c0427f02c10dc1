"""Similarities of vectors and names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array<double>; 0 if one has length 0."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def fisher_distance(a: Column, b: Column, va: Column, vb: Column) -> Column:
    """Distance of Gaussians with means a, b and constant variances: hyperbolic in each dimension, then Euclidean."""
    spread = F.pow(F.sqrt(va) - F.sqrt(vb), F.lit(2.0))
    each = F.zip_with(a, b, lambda x, y: F.pow(F.acosh(1 + ((x - y) * (x - y) / 2 + spread) / (2 * F.sqrt(va * vb))), F.lit(2.0)))
    return F.sqrt(2 * F.aggregate(each, F.lit(0.0), lambda s, v: s + v))


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two strings."""
    if a == b:
        return 1.0 if a else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, found = list(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] == ch:
                free[j] = ""
                found.append((i, j))
                break
    if not found:
        return 0.0
    ordered = sorted(j for _, j in found)
    moved = sum(b[j] != a[i] for (i, _), j in zip(found, ordered, strict=True)) // 2
    m = len(found)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def winkler(x: str, y: str) -> float:
    """Of two strings that are not null."""
    s = jaro(x, y)
    same = next((i for i in range(4) if x[i : i + 1] != y[i : i + 1] or not x[i : i + 1]), 4)
    return s + 0.1 * same * (1 - s) if s > 0.7 else s


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro similarity raised by a common start of up to four characters where it is over 0.7; nulls give null."""

    return pd.Series([None if x is None or y is None else winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def disagreement(a: Column, b: Column, stretched: Column) -> Column:
    """Length of an edge's coboundary over the lengths of its ends' images: 0 where they agree, 1 and more where not.

    Both ends are mapped by the same restriction: the identity, or where stretched 0.7 I plus 0.3 of the projection on
    their difference. That map keeps the difference as it is and shortens what is across it, so three inner products
    tell all lengths and no matrix is built. Null where an end is null, empty or of another length.
    """
    d = F.zip_with(a, b, lambda x, y: x - y)
    gap = F.greatest(dot(d, d), F.lit(1e-12))

    def image(v: Column) -> Column:
        along = dot(v, d)
        return F.sqrt(F.when(stretched, 0.49 * dot(v, v) + 0.51 * along * along / gap).otherwise(dot(v, v)))

    value = F.sqrt(dot(d, d)) / (image(a) + image(b) + 1e-12)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), value)
