"""Vectors as arrays of doubles: expressions without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def clipped(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalized(v: Column) -> Column:
    """Divided by its sum; null where the mass isn't positive (see require_mass)."""
    return let(v, lambda a: let(total(a), lambda mass: F.when(mass > 0, F.transform(a, lambda x: x / mass))))


def require_mass(v: Column, what: str = "vector without positive mass") -> Column:
    return F.when(total(v) > 0, v).otherwise(F.raise_error(F.lit(what)))


def clipped_normalized(v: Column) -> Column:
    return normalized(clipped(v))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _kl(x: Column, m: Column) -> Column:
    return F.when(x > 0, x * F.ln(x / m)).otherwise(F.lit(0.0))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence to base 2, of distributions."""
    parts = F.zip_with(p, q, lambda x, y: _kl(x, (x + y) / 2) + _kl(y, (x + y) / 2))
    return F.sqrt(F.greatest(total(parts), F.lit(0.0)) / F.lit(2.0) / F.ln(F.lit(2.0)))


def cosine(a: Column, b: Column, zero: float | None = None) -> Column:
    """Cosine similarity; zero (default null) for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(zero).cast("double"))


def hellinger(p: Column, q: Column) -> Column:
    return F.sqrt(total(F.zip_with(p, q, lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), F.lit(2.0))))) / F.sqrt(F.lit(2.0))


def argmax(v: Column) -> Column:
    """Index (from 0) of the first greatest element."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def npmi(pair: Column, df_a: Column, df_b: Column, n_docs: Column) -> Column:
    """Normalized pointwise mutual information of document counts: 0 without documents, -1 without common ones, 1 if both
    are in all."""
    p = pair / n_docs
    value = F.ln(p / ((df_a / n_docs) * (df_b / n_docs))) / -F.ln(p)
    return F.when((df_a <= 0) | (df_b <= 0), F.lit(0.0)).when(pair <= 0, F.lit(-1.0)).when(pair >= n_docs, F.lit(1.0)).otherwise(value)
