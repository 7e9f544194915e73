"""Complex numbers as pairs of double columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

Pair = tuple[Column, Column]


def pair(re: str = "re", im: str = "im") -> Pair:
    return F.col(re).cast("double"), F.col(im).cast("double")


def cmul(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def cexp(angle: Column) -> Pair:
    """e^(j angle)."""
    return F.cos(angle), F.sin(angle)


def cabs(a: Pair) -> Column:
    return F.sqrt(a[0] * a[0] + a[1] * a[1])


def floor_mod(a: Column, n) -> Column:
    """a mod n with the sign of n, for doubles and integers."""
    return F.pmod(a, F.lit(n))


def window_weight(kind: str, index: Column, length: int) -> Column:
    """Symmetric window: a - b cos(2 pi i / (L - 1)); 1 for a single sample."""
    if kind == "none" or length == 1:
        return F.lit(1.0)
    a, b = {"hann": (0.5, 0.5), "hamming": (0.54, 0.46)}[kind]
    return F.lit(a) - F.lit(b) * F.cos(F.lit(2.0 * math.pi) * index / F.lit(float(length - 1)))
