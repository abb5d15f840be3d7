"""Scalar score functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decision threshold, its margin, disagreement bounds, sentences that make a sample.
TAU, MARGIN, LOW, HIGH, ENOUGH = -0.0073, 0.003, 0.20, 0.80, 3


def confidence(diff: Column, tau: float = TAU) -> Column:
    return (F.tanh(F.lit(50.0) * (diff - F.lit(tau))) + 1) / 2


def verdict(diff: Column, tau: float = TAU) -> Column:
    """1 over tau, 0 otherwise; 'incert' without a score."""
    return F.when(diff.isNull(), "incert").when(diff > F.lit(tau), "cls1").otherwise("cls0")


def borderline(diff: Column, p1: Column, n: Column, tau: float = TAU) -> Column:
    """Why a verdict is doubtful: the first reason that holds, or null."""
    over = diff > F.lit(tau)
    return (
        F.when(diff.isNull(), F.lit(None).cast("string")).when(~over & (p1 > HIGH), "dezacord_m2_cls1_m3_cls0").when(over & (p1 < LOW), "dezacord_m3_cls1_m2_cls0")
        .when(F.abs(diff - F.lit(tau)) < MARGIN, "proximitate_threshold").when(n < ENOUGH, "esantion_mic")
    )


def band(diff: Column, tau: float = TAU) -> Column:
    """Five bands around tau for display."""
    near = abs(tau)
    strong = round(4.1 * near, 3)
    d = diff - F.lit(tau)
    return F.when(d > strong, "strong_1").when(d > near, "weak_1").when(d >= -near, "unclear").when(d >= -strong, "weak_0").otherwise("strong_0")


def unit(v: Column) -> Column:
    """A vector of length 1 (a zero vector stays)."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def softmax1(l0: Column, l1: Column) -> Column:
    return 1 / (1 + F.exp(l0 - l1))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def certainty(pred: Column, p1: Column) -> Column:
    return F.when(pred == 1, p1).otherwise(1 - p1)


#: A published rational approximation of the complementary error function (relative error under 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided(z: Column) -> Column:
    """Probability that a normal deviate is at least as far from 0 as z; null for null."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + x / 2)
    series = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        series = series * t + F.lit(c)
    return F.when(z.isNotNull(), F.least(F.lit(1.0), t * F.exp(series - x * x)))


def kolmogorov(x: Column, terms: int = 20) -> Column:
    """Limiting probability that a scaled Kolmogorov-Smirnov distance is at least x."""
    part = lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * k * k * x * x)
    p = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), part), F.lit(0.0), lambda a, y: a + y)
    return F.when(x < 0.2, 1.0).when(x >= 0.2, F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
