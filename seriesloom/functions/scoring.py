"""Forecast densities, intervals and scores as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard normal quantiles of the upper ends of central 50/80/90/95 % intervals.
NORMAL_Z = {
    50: 0.6744897501960817,
    80: 1.2815515655446004,
    90: 1.6448536269514722,
    95: 1.959963984540054,
}
# Abramowitz and Stegun 26.2.17, |error| < 7.5e-8.
NORMAL_CDF_P = 0.2316419
NORMAL_CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
LOG_2PI = math.log(2 * math.pi)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (Spark has no ``erf``)."""
    k = F.lit(1.0) / (F.lit(1.0) + NORMAL_CDF_P * F.abs(z))
    poly = F.lit(NORMAL_CDF_B[4])
    for b in NORMAL_CDF_B[3::-1]:
        poly = poly * k + F.lit(b)
    tail = F.exp(z * z * F.lit(-0.5)) / F.lit(math.sqrt(2 * math.pi)) * poly * k
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def normal_log_density(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return z * z * F.lit(-0.5) - F.ln(sd) - F.lit(0.5 * LOG_2PI)


def log_add(a: Column, b: Column) -> Column:
    """Stable log(exp(a) + exp(b)); a NULL side stands for log 0."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, hi + F.log1p(F.exp(lo - hi))).otherwise(F.coalesce(a, b))


def mixture_terms(x: Column, mean: Column, sd: Column, outlier: Column, outlier_sd: Column):
    """Weighted log densities of the inlier and the outlier part (NULL where the weight is 0)."""
    inlier = F.when(outlier < 1, F.log1p(-outlier)) + normal_log_density(x, mean, sd)
    tail = F.when(outlier > 0, F.ln(outlier)) + normal_log_density(x, mean, outlier_sd)
    return inlier, tail


def mixture_log_density(x, mean, sd, outlier, outlier_sd) -> Column:
    return log_add(*mixture_terms(x, mean, sd, outlier, outlier_sd))


def outlier_responsibility(x, mean, sd, outlier, outlier_sd) -> Column:
    _, tail = mixture_terms(x, mean, sd, outlier, outlier_sd)
    total = mixture_log_density(x, mean, sd, outlier, outlier_sd)
    return F.coalesce(F.exp(tail - total), F.lit(0.0))


def mixture_cdf(x, mean, sd, outlier, outlier_sd) -> Column:
    return (F.lit(1.0) - outlier) * normal_cdf((x - mean) / sd) + outlier * normal_cdf(
        (x - mean) / outlier_sd
    )


def central_interval(mean: Column, sd: Column, multiplier: float) -> tuple[Column, Column]:
    return mean - F.lit(multiplier) * sd, mean + F.lit(multiplier) * sd


def interval_score(truth: Column, lower: Column, upper: Column, alpha: float) -> Column:
    miss = F.greatest(lower - truth, F.lit(0.0)) + F.greatest(truth - upper, F.lit(0.0))
    return F.when(truth.isNotNull(), (upper - lower) + F.lit(2.0 / alpha) * miss)


def weighted_interval_score(
    truth: Column, median: Column, intervals: dict[int, tuple[Column, Column]]
) -> Column:
    """Median plus central intervals given by percent level, divided by (levels + 1/2)."""
    total = F.lit(0.5) * F.abs(truth - median)
    for level, (lower, upper) in intervals.items():
        alpha = (100 - level) / 100.0
        total = total + F.lit(alpha / 2.0) * interval_score(truth, lower, upper, alpha)
    return total / F.lit(len(intervals) + 0.5)


def covered(truth: Column, lower: Column, upper: Column) -> Column:
    return (truth >= lower) & (truth <= upper)


def student_t_cdf(x: float, df: float) -> float:
    """Student-t distribution function through the incomplete beta continued fraction."""
    if x < 0:
        return 1.0 - student_t_cdf(-x, df)
    a, b, z = df / 2.0, 0.5, df / (df + x * x)

    def fraction(a, b, z):
        tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * z / (a + 1)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 400):
            for num in (
                m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d, c = 1.0 + num * d, 1.0 + num / c
                d = 1.0 / (d if abs(d) > tiny else tiny)
                h *= d * (c if abs(c) > tiny else tiny)
            if abs(d * c - 1.0) < 1e-15:
                break
        return h

    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(z) + b * math.log1p(-z if z < 1 else -1 + 1e-300)
    )
    if z < (a + 1) / (a + b + 2):
        tail = math.exp(log_front) * fraction(a, b, z) / a
    else:
        tail = 1.0 - math.exp(log_front) * fraction(b, a, 1 - z) / b
    return 1.0 - 0.5 * tail


def student_t_quantile(probability: float, df: float) -> float:
    """A plan-time constant: quantile by bisection."""
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = 0.5 * (low + high)
        if mid != 0 and student_t_cdf(mid, df) < probability or mid == 0 and probability > 0.5:
            low = mid
        else:
            high = mid
    return 0.5 * (low + high)
