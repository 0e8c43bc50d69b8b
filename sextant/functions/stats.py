"""Student's t distribution without a statistics library."""

from __future__ import annotations

import math


def _continued_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _continued_fraction(a, b, x) / a
    return 1.0 - front * _continued_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0 if not math.isnan(t) else math.nan


def t_quantile(p: float, df: float) -> float:
    """The point below which the share p lies, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while 1 - t_two_sided(hi, df) / 2 < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2
