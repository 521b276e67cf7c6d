"""Noise and masks on vectors. A value's noise depends on the sample, its place and a seed, so a task that runs again makes the same."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _uniform(key: Column, place: Column, seed: int) -> Column:
    """In (0, 1]."""
    return (F.pmod(F.xxhash64(key, place, F.lit(seed)), F.lit(1 << 52)) + 1) / float(1 << 52)


def standard_normal(key: Column, place: Column, seed: int = 0) -> Column:
    """By the method of Box and Muller, from two hashes."""
    return F.sqrt(-2 * F.log(_uniform(key, place, 2 * seed))) * F.cos(2 * math.pi * _uniform(key, place, 2 * seed + 1))


def additive_noise(x: Column, key: Column, spread: float = 1.0, seed: int = 0) -> Column:
    return F.transform(x, lambda v, i: v + spread * standard_normal(key, i, seed))


def randomized_mask(x: Column, key: Column, amount: Sequence[float], mean: Sequence[float], spread: Sequence[float], removed: Sequence[bool] | None = None, seed: int = 0) -> Column:
    """Each component mixed with noise of its own mean and spread, amount 1 being noise only, less the removed ones."""
    numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])
    noise = lambda i: F.get(numbers(mean), i) + F.get(numbers(spread), i) * standard_normal(key, i, seed)
    mixed = F.transform(x, lambda v, i: (1 - F.get(numbers(amount), i)) * v + F.get(numbers(amount), i) * noise(i))
    if removed is None:
        return mixed
    return F.array(*[F.get(mixed, k) for k, gone in enumerate(removed) if not gone])
