"""Tail probabilities for the few test statistics of a regression report.

They act on single numbers on the driver, never on rows.
"""

from __future__ import annotations

import math


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(b, a, 1 - x)
    tiny = 1e-300
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    value = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + step * d or tiny)
            c = 1.0 + step / c or tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def student_two_sided(t: float, freedom: float) -> float:
    return beta_share(freedom / 2, 0.5, freedom / (freedom + t * t))


def f_upper(f: float, above: float, below: float) -> float:
    return 0.0 if math.isinf(f) else beta_share(below / 2, above / 2, below / (below + above * f))


def student_quantile(p: float, freedom: float) -> float:
    """The t with upper two-sided probability ``2 * (1 - p)``, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_two_sided(mid, freedom) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


def chi_square_2_upper(x: float) -> float:
    return math.exp(-x / 2)
