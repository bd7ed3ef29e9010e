"""Tail probabilities of the t and F distributions, from the incomplete beta function."""

from __future__ import annotations

import math


def log_gamma_ratio(a: float, b: float) -> float:
    """log gamma(a + b) - log gamma(b); for large b by Stirling's series, term by term, so no digits cancel."""
    if b < 1e3:
        return math.lgamma(a + b) - math.lgamma(b)
    c = a + b
    series = (1 / c - 1 / b) / 12 - (1 / c**3 - 1 / b**3) / 360
    return (b - 0.5) * math.log1p(a / b) + a * math.log(c) - a + series


def incomplete_beta(a: float, b: float, x: float, rest: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz); NaN if it does not settle.

    ``rest`` is 1 - x, given apart because it loses its digits where x is near 1.
    """
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    # Near x = 1 the fraction itself would lose digits; far out in the tail the difference to 1 would.
    if x > (a + 1) / (a + b + 2) or (rest < 1e-4 and a * rest < 8):
        return 1.0 - _by_fraction(b, a, rest, x)
    return _by_fraction(a, b, x, rest)


def _by_fraction(a: float, b: float, x: float, rest: float) -> float:
    low, high = min(a, b), max(a, b)
    log_front = log_gamma_ratio(low, high) - math.lgamma(low) + a * math.log(x) + b * (math.log1p(-x) if x < 0.5 else math.log(rest))
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1.0) < 1e-15:
            return math.exp(log_front) * h / a
    return math.nan


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f), df1 * f / (df2 + df1 * f))
