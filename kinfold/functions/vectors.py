"""Vector arithmetic as column expressions: transparent, and the yardstick for the
faster block forms in :mod:`kinfold.operators.search`. All sums are doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(l2_norm(a), F.lit(1e-12)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(l2_norm(a) * l2_norm(b), F.lit(1e-24))


def mean_pool(tokens: Column, dim: int) -> Column:
    """Mean of token vectors by dimension; zeros for no tokens."""
    zero = F.array_repeat(F.lit(0.0), dim)
    summed = F.aggregate(tokens, zero, lambda acc, t: F.zip_with(acc, t, lambda x, y: x + y.cast("double")))
    return F.transform(summed, lambda x: x / F.greatest(F.size(tokens), F.lit(1)))


def mean_pool_inner(tokens: Column, dim: int) -> Column:
    """Unit-length mean without the first and last token (the special ones)."""
    inner = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))
    return l2_normalize(mean_pool(inner, dim))


def project(a: Column, weights: Sequence[Sequence[float]]) -> Column:
    """The vector times a matrix (a row per output)."""
    return F.array(*[dot(a, F.array(*[F.lit(float(w)) for w in row])) for row in weights])


def maxsim(query: Column, doc: Column) -> Column:
    """Sum over query tokens of the greatest dot product with a document token. Not
    symmetric, not divided by length; null for a document without tokens."""
    score = total(F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d)))))
    return F.when(F.size(doc) > 0, score)


def signature_agreement(a: Column, b: Column) -> Column:
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)
    return F.size(same) / F.greatest(F.size(a), F.lit(1)).cast("double")
