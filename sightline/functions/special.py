"""Special functions for small driver-side results: regularised incomplete beta and its uses."""

from __future__ import annotations

from math import exp, lgamma, log, log1p
from statistics import NormalDist


def _continued(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    return front * _continued(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _continued(b, a, 1 - x) / b


def beta_quantile(a: float, b: float, p: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(a, b, mid) < p else (low, mid)
    return (low + high) / 2


def clopper_pearson(x: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a binomial share."""
    tail = (1 - level) / 2
    return (0.0 if x == 0 else beta_quantile(x, n - x + 1, tail)), (1.0 if x == n else beta_quantile(x + 1, n - x, 1 - tail))


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_cdf(x: float) -> float:
    return NormalDist().cdf(x)


def bca_levels(share_below: float, jackknife: list[float], alpha: float = 0.05) -> tuple[float, float]:
    """Percentile levels of the bias-corrected accelerated interval."""
    z0 = normal_quantile(min(max(share_below, 1e-9), 1 - 1e-9))
    mean = sum(jackknife) / len(jackknife)
    cube, square = sum((mean - j) ** 3 for j in jackknife), sum((mean - j) ** 2 for j in jackknife)
    a = cube / (6 * square**1.5) if square else 0.0
    level = lambda z: normal_cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))
    return level(normal_quantile(alpha / 2)), level(normal_quantile(1 - alpha / 2))
