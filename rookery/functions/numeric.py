"""Numeric column helpers: exact half-even rounding, fixed-point text, clamps, special functions."""

from __future__ import annotations

import math

import numpy as np

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two 26-bit halves


def clamp(value: Column, low, high) -> Column:
    """Limit a value to [low, high]; NULL stays NULL."""
    low, high = F.lit(low), F.lit(high)
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def half_even(value: Column, digits: int = 0) -> Column:
    """Round to `digits` decimals, ties judged on the exact binary value and sent to even.

    `bround` judges ties on the shortest decimal text, so 2.45 (stored slightly above) would go
    down. Here the rounding error of value*10^digits is recovered exactly, which decides the tie.
    """
    x = value.cast("double")
    scale = float(10**digits)
    product = x * F.lit(scale)
    high = (x * F.lit(_SPLIT)) - ((x * F.lit(_SPLIT)) - x)
    residue = (high * F.lit(scale) - product) + (x - high) * F.lit(scale)
    base = F.floor(product).cast("double")
    part = product - base
    up = (part > 0.5) | (
        (part == 0.5) & ((residue > 0) | ((residue == 0) & (F.pmod(base, F.lit(2.0)) == 1.0)))
    )
    rounded = F.when(up, base + 1.0).otherwise(base) / F.lit(scale)
    return F.when(F.abs(product) < 4.5e15, rounded).otherwise(x)


def fixed_text(value: Column, digits: int, sign: bool = False) -> Column:
    """Fixed-point text with half-even ties, optionally with an explicit plus sign."""
    pattern = f"%{'+' if sign else ''}.{digits}f"
    return F.when(value.isNotNull(), F.format_string(pattern, half_even(value, digits)))


def short_text(value: Column) -> Column:
    """Shortest text of a half-point score: 3.5 stays 3.5 and 4.0 becomes 4."""
    return F.regexp_replace(F.format_string("%.1f", value.cast("double")), r"\.0$", "")


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / max(1, denominator)."""
    return numerator / F.greatest(F.lit(1), denominator)


@F.pandas_udf(DoubleType())
def erfc(values: pd.Series) -> pd.Series:
    """Complementary error function; meant for result rows, one per test."""
    return values.map(lambda v: None if v is None or math.isnan(v) else math.erfc(v))


def chi2_p(statistic: Column) -> Column:
    """Upper tail of a chi-square with one degree of freedom."""
    return erfc(F.sqrt(statistic / 2))


def normal_two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def log_factorial(n: Column) -> Column:
    """ln n! : exact below 21, Stirling series above (error < 1e-13)."""
    x = n.cast("double")
    small = F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))
    series = (
        x * F.ln(x) - x + 0.5 * F.ln(x * (2 * math.pi))
        + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5.0))
    )
    return F.when(n <= 20, small).otherwise(series)


# Gauss-Legendre nodes and weights on [0, 1]
_NODES, _WEIGHTS = (x.tolist() for x in ((lambda n, w: ((n + 1) / 2, w / 2))(*np.polynomial.legendre.leggauss(128))))


def binomial_two_sided_p(low: Column, total: Column) -> Column:
    """Two-sided exact p of a fair binomial: min(1, 2·P(X ≤ low)) for low ≤ total/2.

    P(X ≤ k) is the incomplete beta integral of t^(n-k-1) (1-t)^k up to 1/2, taken with one fixed
    quadrature over the 40 standard deviations below 1/2 that hold it (all of it for small n).
    """
    n, k = total.cast("double"), low.cast("double")
    scale = log_factorial(total) - log_factorial(low) - log_factorial(total - low) - (n - 1) * math.log(2.0)
    width = F.least(F.lit(0.5), 20 / F.sqrt(F.greatest(n, F.lit(1.0))))
    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in zip(_NODES, _WEIGHTS)])
    integral = F.aggregate(
        nodes,
        F.lit(0.0),
        lambda s, node: s + node["w"] * F.exp(
            scale + (n - k - 1) * F.log1p(-2 * width * node["x"]) + k * F.log1p(2 * width * node["x"])
        ),
    )
    return F.when(total == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * (n - k) * width * integral))
