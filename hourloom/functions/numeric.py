"""Numeric expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTILE_GRID = [round(0.05 * i, 2) for i in range(1, 20)]


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def is_finite(c: Column) -> Column:
    """False, never NULL, for missing, NaN and infinite values."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)


def clip_low(c: Column, low: float = 0.0) -> Column:
    """`greatest` that keeps NULL (the built-in skips NULL arguments)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def ratio(num: Column, den: Column) -> Column:
    """NULL when the denominator is missing or zero."""
    return num / F.nullif(den, F.lit(0.0))


def uniform(*key: Column) -> Column:
    """Reproducible uniform in [0, 1) from the key's text; any engine with md5 can recompute it."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def pinball_mean(y: Column, quantiles: Column, taus: list[float] = QUANTILE_GRID) -> Column:
    """Twice the mean pinball loss over the quantile grid; NULL if any part is missing."""
    tau_array = F.array(*[F.lit(t) for t in taus])
    losses = F.zip_with(
        quantiles,
        tau_array,
        lambda q, t: F.when(y.isNotNull() & q.isNotNull(), F.greatest(t * (y - q), (t - 1) * (y - q))),
    )
    total = F.aggregate(losses, F.lit(0.0), lambda acc, x: acc + x)
    return F.lit(2.0) * total / F.lit(len(taus))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, to double precision (there is no built-in one).

    Below 3 one less the series of erf, whose terms are all positive: each is 2 x^2 / (2 k + 1) times the one before. From 3 on the continued
    fraction, evaluated from its tail.
    """
    bell = F.exp(-x * x) / F.lit(math.sqrt(math.pi))
    term = lambda acc, k: F.struct(
        (acc["term"] * F.lit(2.0) * x * x / (F.lit(2.0) * k + 1)).alias("term"),
        (acc["sum"] + acc["term"] * F.lit(2.0) * x * x / (F.lit(2.0) * k + 1)).alias("sum"))
    steps = F.sequence(F.lit(1), F.lit(80))
    series = F.aggregate(steps, F.struct(x.cast("double").alias("term"), x.cast("double").alias("sum")), term, lambda acc: acc["sum"])
    tail = F.aggregate(F.reverse(steps), x.cast("double"), lambda acc, k: x + k / F.lit(2.0) / acc)
    return F.when(x < 3, F.lit(1.0) - F.lit(2.0) * bell * series).otherwise(bell / tail)


def robust_scale(x: Column, median: Column, mad: Column) -> Column:
    return F.asinh((x - median) / safe_mad(mad))


def robust_unscale(z: Column, median: Column, mad: Column) -> Column:
    return F.sinh(z) * safe_mad(mad) + median


def safe_mad(mad: Column) -> Column:
    return F.when(mad < 1e-8, F.lit(1.0)).otherwise(mad)


def std_normal(u1: Column, u2: Column) -> Column:
    """Box-Muller transform of two uniforms."""
    return F.sqrt(F.lit(-2.0) * F.log(F.greatest(u1, F.lit(1e-300)))) * F.cos(F.lit(6.283185307179586) * u2)


def triangular(u: Column, left: Column, mode: Column, right: Column) -> Column:
    """Inverse triangular distribution function; a constant when both ends agree."""
    width = F.nullif(right - left, F.lit(0.0))
    split = (mode - left) / width
    low = left + F.sqrt(u * width * (mode - left))
    high = right - F.sqrt((F.lit(1.0) - u) * width * (right - mode))
    return F.when(left == right, left).when(u < split, low).otherwise(high)
