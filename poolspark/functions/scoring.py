"""Score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic_score(a: Column, b: Column) -> Column:
    """sigmoid(1.5 a - b + 0.8 a b)."""
    score = F.lit(1.5) * a - b + F.lit(0.8) * a * b
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def uncertainty(p: Column) -> Column:
    """Distance from the decision boundary; small means uncertain."""
    return F.abs(p - F.lit(0.5))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two equally long arrays, in double precision."""
    diff = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")))
    return F.aggregate(diff, F.lit(0.0), lambda acc, d: acc + d * d)
