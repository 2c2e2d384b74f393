"""Integer hash expressions that Spark and other SQL engines compute alike: no overflow, no floating point.

All are SQL texts over BIGINT operands below 2^31, so that products stay below 2^63.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647
PPM = 1_000_000


def mixed(x: str) -> str:
    """A quadratic mix of x modulo the prime: affine alone would keep differences between vectors."""
    t = f"(({x}) % {PRIME})"
    return f"((({t} * {t}) % {PRIME}) * 16807 + {t}) % {PRIME}"


def draw(row: str, slot: str, salt: int) -> str:
    """A stateless uniform draw in [0, 10^6) for a (row, slot) pair."""
    return f"(({mixed(f'(({row}) % {PRIME}) * 48271 + (({slot}) % {PRIME}) * 69621 + {salt}')}) % {PPM})"


def drawn(row: np.ndarray, slot: np.ndarray, salt: int) -> np.ndarray:
    """draw() of arrays; the remainder has the sign of the dividend, as in SQL."""
    t = np.fmod(np.fmod(row, PRIME) * 48271 + np.fmod(slot, PRIME) * 69621 + salt, PRIME)
    return np.fmod(np.fmod(np.fmod(t * t, PRIME) * 16807 + t, PRIME), PPM)


def family_a(h: str, cluster: str, seed: int) -> str:
    return f"(1 + ({mixed(f'({h} + 1) * 2654435 + ({cluster} + 1) * 40503 + {seed}')}) % {PRIME - 1})"


def family_b(h: str, cluster: str, seed: int) -> str:
    return f"({mixed(f'({h} + 1) * 6700417 + ({cluster} + 1) * 19349663 + {seed} * 31 + 7')})"


def affine_hash(a: str, b: str, x: str, domain: str) -> str:
    """((a * x + b) mod 2^31 - 1) mod domain."""
    return f"((({a}) * ({x}) + ({b})) % {PRIME}) % ({domain})"


def affine(a: Column, b: Column, x: Column, domain: Column) -> Column:
    return ((a * x + b) % F.lit(PRIME)) % domain


def family(m: int, cluster: int = 0, seed: int = 2026) -> list[tuple[int, int]]:
    """The (a, b) pairs of one cluster's hash family, as the SQL texts give them."""

    def mix(x: int) -> int:
        t = x % PRIME
        return (t * t % PRIME * 16807 + t) % PRIME

    return [(1 + mix((h + 1) * 2654435 + (cluster + 1) * 40503 + seed) % (PRIME - 1), mix((h + 1) * 6700417 + (cluster + 1) * 19349663 + seed * 31 + 7)) for h in range(m)]


def band_key(hashes: Column, bucket: int) -> Column:
    """The hashes of a band folded into one bucket number."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, x: F.pmod(s * 31 + x, F.lit(bucket)))
