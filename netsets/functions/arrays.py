"""Vector expressions on array<double> columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def floored(a: Column, eps: float) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(eps)))


def mahalanobis2(x: Column, mu: Column, var: Column) -> Column:
    """The squared Mahalanobis distance of x to a diagonal Gaussian."""
    squares = F.zip_with(x, mu, lambda a, b: (a - b) * (a - b))
    return total(F.zip_with(squares, var, lambda s, v: s / v))


def gaussian_score(x: Column, mu: Column, var: Column, score: str) -> Column:
    """loglik (without its constant) or neg_mahalanobis of x under a diagonal Gaussian."""
    md2 = mahalanobis2(x, mu, var)
    return -md2 if score == "neg_mahalanobis" else -(md2 + total(F.transform(var, F.ln))) / 2
