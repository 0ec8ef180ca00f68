"""Counter-based random numbers: value i of a seed is a function of (seed, i) alone, at any partitioning and in any order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits_at(idx: Column, seed: int, stream: int = 0) -> Column:
    """64 bits as a long: the public xxHash64 of seed, stream and index, in Spark's chaining."""
    return F.xxhash64(F.lit(seed).cast("long"), F.lit(stream).cast("long"), idx.cast("long"))


def unit_at(idx: Column, seed: int, stream: int = 0) -> Column:
    """Above 0 and below 1, in steps of 2^-52."""
    return (F.shiftrightunsigned(bits_at(idx, seed, stream), 12).cast("double") + 0.5) * 2.0**-52


def uniform_at(idx: Column, seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    return unit_at(idx, seed) * (high - low) + low


def normal_at(idx: Column, seed: int) -> Column:
    """Standard normal values, from two streams of one seed (Box and Muller)."""
    return F.sqrt(F.ln(unit_at(idx, seed, 0)) * -2.0) * F.cos(unit_at(idx, seed, 1) * (2 * math.pi))


def choice_at(idx: Column, seed: int, values: list[float]) -> Column:
    """One of ``values``, all equally likely."""
    return F.get(F.array(*[F.lit(float(v)) for v in values]), F.floor(unit_at(idx, seed) * len(values)).cast("int"))
