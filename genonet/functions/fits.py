"""Fits of discrete distributions to counts from 1 up, from six sums, and their comparison.

A power law x^-a, an exponential e^-bx and a truncated power law x^-a e^-bx have log likelihoods that
are linear in the number of values, the sum of their logarithms and their sum. So one aggregation
in Spark, however many values there are, is all that a fit and the variance in a comparison need.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of a normalising sum that are added one by one; the rest is an integral.
TERMS = 100_000
#: Where few values occur, ever steeper truncated laws can fit ever better; the steps end at this exponent.
STEEPEST = 60
LAWS = ("power_law", "exponential", "truncated_power_law")
PAIRS = (("truncated_power_law", "power_law"), ("truncated_power_law", "exponential"), ("power_law", "exponential"))


@dataclass
class Sums:
    """Number, sum of log x and of x, and sums of their squares and product."""

    n: int
    log: float
    x: float
    log2: float
    x2: float
    logx: float


def sums(values: DataFrame, column: str) -> Sums:
    own = values.where(F.col(column) >= 1).select(F.col(column).cast("double").alias("x"), F.log(F.col(column).cast("double")).alias("l"))
    row = own.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(k) for k, c in {"log": F.col("l"), "x": F.col("x"), "log2": F.col("l") * F.col("l"), "x2": F.col("x") * F.col("x"), "logx": F.col("l") * F.col("x")}.items()]).first()
    return Sums(**row.asDict())


def moments(a: float, b: float) -> tuple[float, np.ndarray, np.ndarray]:
    """log of the sum over x >= 1 of x^-a e^-bx, and mean and covariance of (log x, x) under that law; b > 0, or b = 0 and a > 3 for all to be finite."""
    x = np.arange(1, TERMS + 1, dtype=float)
    parts = [(x, np.exp(-a * np.log(x) - b * x))]
    if b * TERMS < 700:
        # trapezoids over log x from half a step behind the last term
        top = math.log(TERMS + 0.5) + (60 / max(a - 1, 0.05) if b == 0 else max(0.0, math.log(750 / (b * (TERMS + 0.5)))))
        u = np.linspace(math.log(TERMS + 0.5), top, 40_001)
        w = np.full(len(u), u[1] - u[0])
        w[[0, -1]] /= 2
        e = np.exp(u)
        parts.append((e, np.exp((1 - a) * u - b * e) * w))
    z = math.fsum(p.sum() for _, p in parts)
    stats = [np.stack([np.log(v), v]) for v, _ in parts]
    mean = sum((s * p).sum(1) for s, (_, p) in zip(stats, parts, strict=True)) / z
    second = sum((s * p) @ s.T for s, (_, p) in zip(stats, parts, strict=True)) / z
    return math.log(z), mean, second - np.outer(mean, mean)


def _power_law(s: Sums) -> tuple[float, float, float]:
    """Log-likelihood of a value as c + d log x + e x: by Newton steps on the exponent."""
    target = s.log / s.n
    if target <= 0:
        return 0.0, -math.inf, 0.0
    a = 1 + 1 / (target + math.log(2))
    for _ in range(100):
        _, mean, cov = moments(a, 0.0)
        new = max(1 + (a - 1) / 4, a + (mean[0] - target) / cov[0, 0])
        if abs(new - a) < 1e-12 * a:
            break
        a = new
    return -moments(a, 0.0)[0], -a, 0.0


def _exponential(s: Sums) -> tuple[float, float, float]:
    mean = s.x / s.n
    if mean <= 1:
        return 0.0, 0.0, -math.inf
    b = math.log(mean / (mean - 1))
    return math.log(math.expm1(b)), 0.0, -b


def _truncated(s: Sums) -> tuple[float, float, float]:
    """By Newton steps on both parameters; b ends at 0 where the power law alone is the best."""
    target = np.array([s.log, s.x]) / s.n
    if target[1] <= 1:
        return _exponential(s)
    gain = lambda a, b: -a * target[0] - b * target[1] - moments(a, b)[0]
    a, b = 0.0, math.log(target[1] / (target[1] - 1))
    best = gain(a, b)
    for _ in range(200):
        _, mean, cov = moments(a, b)
        if abs(a) > STEEPEST or np.linalg.cond(cov) > 1e14:  # the likelihood rises without end, or no more by what can be told
            break
        step = np.linalg.solve(cov, mean - target)
        size = 1.0
        while size > 1e-8:
            x, y = a + size * step[0], b + size * step[1]
            if y > 1e-12 and (new := gain(x, y)) >= best:
                break
            size /= 2
        else:
            break
        done = abs(x - a) + abs(y - b) < 1e-12
        a, b, best = x, y, new
        if done:
            break
    c, d, e = _power_law(s)
    if math.isfinite(d) and c + d * target[0] >= best:
        return c, d, e
    return -moments(a, b)[0], -a, -b


def fit(s: Sums) -> dict[str, tuple[float, float, float]]:
    """For each law c, d and e of the log-likelihood c + d log x + e x of a value."""
    return {"power_law": _power_law(s), "exponential": _exponential(s), "truncated_power_law": _truncated(s)}


def likelihood(law: tuple[float, float, float], s: Sums) -> float:
    return sum(k * v for k, v in zip(law, (s.n, s.log, s.x), strict=True) if v)


def compared(first: tuple, second: tuple, s: Sums, nested: bool) -> tuple[float, float]:
    """The log likelihood ratio of two laws, over 0 where the first is the better, and its p.

    Of nested laws twice the ratio is chi-square with one degree of freedom; else it is normal with the
    variance of the values' ratios.
    """
    c, d, e = (x - y for x, y in zip(first, second, strict=True))
    ratio = c * s.n + d * s.log + e * s.x
    if nested:
        return ratio, math.erfc(math.sqrt(abs(ratio)))
    square = c * c * s.n + d * d * s.log2 + e * e * s.x2 + 2 * (c * d * s.log + c * e * s.x + d * e * s.logx)
    variance = square / s.n - (ratio / s.n) ** 2
    return ratio, math.erfc(abs(ratio) / math.sqrt(2 * s.n * variance)) if variance > 1e-12 else 1.0


def comparison(values: DataFrame, column: str) -> tuple[dict[str, float], list[tuple[str, str, float, float]]]:
    """Parameters and log likelihoods of the three fits, and first, second, ratio and p of each two. Nothing without two distinct values from 1 up."""
    s = sums(values, column)
    if not s.n or s.x2 / s.n - (s.x / s.n) ** 2 < 1e-12:
        return {}, []
    laws = fit(s)
    found = {"alpha": -laws["power_law"][1], "lambda": -laws["exponential"][2], "truncated_alpha": -laws["truncated_power_law"][1], "truncated_lambda": -laws["truncated_power_law"][2]}
    found |= {k: likelihood(v, s) for k, v in laws.items()}
    return found, [(x, y, *compared(laws[x], laws[y], s, nested=y in x)) for x, y in PAIRS]
