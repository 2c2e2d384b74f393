"""Derived parameters of an index, as columns over cluster sizes and as plain functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smooth_m0(c: float) -> int:
    """ceil(150 + 100 * max(0, (c - 0.5) / 0.5))."""
    return math.ceil(round(150 + 100 * max(0.0, (c - 0.5) / 0.5), 9))


def default_m0(c: float) -> int:
    return 200 if c >= 0.85 else 170 if c >= 0.7 else 150 if c >= 0.5 else 120


def size_dependent_eta(n: int) -> float:
    return 0.03 if n >= 1_000_000 else 0.05 if n >= 100_000 else 0.15


def smooth_m0_of(c: Column) -> Column:
    """smooth_m0() of a column."""
    return F.ceil(F.round(150 + 100 * F.greatest(F.lit(0.0), (c - 0.5) / 0.5), 9)).cast("int")


def size_dependent_eta_of(n: Column) -> Column:
    """size_dependent_eta() of a column."""
    return F.when(n >= 1_000_000, F.lit(0.03)).when(n >= 100_000, F.lit(0.05)).otherwise(F.lit(0.15))


def adaptive_params(sizes: DataFrame, n: int, k: int, m0: int, eta: float) -> DataFrame:
    """(cluster_id, n_i, m_i, t_budget): the number of hashes and the verification budget of every cluster.

    m_i = clamp(ceil(ceil(m0 * max(1, ln 2n / ln 2e5)) * clamp(ln 2n_i / ln 2n, 0.3, 1)), 15, 320);
    t_budget = max(5k, ceil(eta * n_i + k)). Logarithms are rounded to nine digits before any ceiling.
    """
    whole = math.ceil(round(m0 * max(1.0, round(math.log(2 * n) / math.log(2e5), 9)), 9))
    share = F.greatest(F.lit(0.3), F.least(F.lit(1.0), F.round(F.ln(2.0 * F.col("n_i")) / F.lit(math.log(2 * n)), 9)))
    m = F.greatest(F.lit(15), F.least(F.lit(320), F.ceil(F.round(F.lit(whole) * share, 9)))).cast("int")
    t = F.greatest(F.lit(5 * k), F.ceil(F.round(F.lit(eta) * F.col("n_i") + k, 9))).cast("int")
    return sizes.select("cluster_id", "n_i", m.alias("m_i"), t.alias("t_budget"))


def uniform_params(sizes: DataFrame, n: int, k: int, m0: int, eta: float) -> DataFrame:
    """The same number of hashes and the same budget, from the whole size, for every cluster."""
    return sizes.select("cluster_id", "n_i", F.lit(m0 if m0 > 0 else 150).alias("m_i"), F.lit(max(5 * k, math.ceil(round(eta * n + k, 9)))).alias("t_budget"))


def gaussian_cdf(x: float, steps: int = 2000) -> float:
    """The normal distribution function by the trapezoid rule from -8."""
    if x <= -8:
        return 0.0
    h = (x + 8) / steps
    f = [math.exp(-((-8 + i * h) ** 2) / 2) for i in range(steps + 1)]
    return h * (sum(f) - (f[0] + f[-1]) / 2) / math.sqrt(2 * math.pi)


def collision_probability(distance: float, width: float) -> float:
    """That of a p-stable hash of the given bucket width at a distance."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return 1 - 2 * gaussian_cdf(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def lsh_tables(n: int, c: float, width: float, near: float = 1.0) -> tuple[int, int]:
    """(K, L): hashes per table and tables, from the collision probabilities at near and near / c."""
    p1, p2 = collision_probability(near, width), collision_probability(near / c, width)
    k = max(1, math.ceil(math.log(max(2, n)) / math.log(1 / p2)))
    return k, max(1, math.ceil(p1 ** (-k)))
