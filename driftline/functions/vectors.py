"""Columns over feature vectors (ARRAY<DOUBLE>), all of them built-in functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def indices(places: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(p)) for p in places])


def gather(x: Column, places: Sequence[int]) -> Column:
    """The components at the given places (from 0), in that order; places may repeat."""
    return F.transform(indices(places), lambda p: F.get(x, p))


def head(x: Column, k: int) -> Column:
    return F.slice(x, 1, k)


def head_inverse(y: Column, size: int) -> Column:
    """y with zeros up to the size."""
    return F.concat(y, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(y)))


def skip(x: Column, n: int) -> Column:
    return F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))


def permutation(size: int, seed: int) -> list[int]:
    """A fixed permutation of range(size), the same everywhere."""
    import numpy as np

    return np.random.default_rng(seed).permutation(size).tolist()


def permutation_inverse(order: Sequence[int]) -> list[int]:
    out = [0] * len(order)
    for k, p in enumerate(order):
        out[p] = k
    return out


def switchboard(x: Column, connections: Sequence[int]) -> Column:
    """A gather whose output k is divided by the root of how often its source is used."""
    times = {c: connections.count(c) for c in set(connections)}
    weights = F.array(*[F.lit(1 / math.sqrt(times[c])) for c in connections])
    return F.zip_with(gather(x, connections), weights, lambda a, b: a * b)


def switchboard_inverse(y: Column, connections: Sequence[int], size: int) -> Column:
    """Each source from the mean of its copies; 0 where it has none."""
    cells = []
    for source in range(size):
        at = [k for k, c in enumerate(connections) if c == source]
        cells.append(sum((F.get(y, k) for k in at), F.lit(0.0)) * (math.sqrt(len(at)) / len(at)) if at else F.lit(0.0))
    return F.array(*cells)


def wider(x: Column, k: int) -> Column:
    """Every component k times."""
    return F.flatten(F.transform(x, lambda v: F.array_repeat(v, k)))


def tile(x: Column, k: int) -> Column:
    """The whole vector k times."""
    return F.flatten(F.array_repeat(x, k))


def without_nulls(x: Column) -> Column:
    return F.filter(x, lambda v: v.isNotNull())


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    def one(v: Column) -> Column:
        v = F.greatest(v, F.lit(float(low))) if low is not None else v
        return F.least(v, F.lit(float(high))) if high is not None else v

    return F.transform(x, one)


def clip_between(x: Column, low: Column, high: Column) -> Column:
    """Component by component between two vectors."""
    return F.zip_with(F.zip_with(x, low, lambda a, b: F.greatest(a, b)), high, lambda a, b: F.least(a, b))


def soft_clip(x: Column, most: float) -> Column:
    return F.transform(x, lambda v: most * F.tanh(v / most))


def soft_clip_inverse(y: Column, most: float) -> Column:
    """Values beyond 0.99 of the bound count as that."""
    top = 0.99 * most
    return F.transform(y, lambda v: most * F.atanh(F.least(F.greatest(v, F.lit(-top)), F.lit(top)) / most))


def signed_power(v: Column, p: float) -> Column:
    return F.signum(v) * F.pow(F.abs(v), F.lit(float(p)))


def scale_to(v: Column, low: float, high: float, to_low: float, to_high: float, tanh: bool = False) -> Column:
    """The interval low to high mapped onto to_low to to_high; with tanh, by a sigmoid that ends there."""
    share = (v - low) / (high - low)
    share = (F.tanh(2 * share - 1) / math.tanh(1) + 1) / 2 if tanh else share
    return to_low + (to_high - to_low) * share


def sigmoid5(v: Column) -> Column:
    return F.tanh(5 * v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, d: s + d)


def root_mean_square(x: Column) -> Column:
    return F.sqrt(dot(x, x) / F.size(x))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def increasing(x: Column) -> Column:
    """Whether each component is over the one before."""
    pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: a < b)
    return F.forall(pairs, lambda p: p)


def written(x: Column, digits: int) -> Column:
    """A comma list with a fixed number of decimals."""
    return F.array_join(F.transform(x, lambda v: F.format_string(f"%.{digits}f", v)), ", ")


def hamming_weight(v: Column) -> Column:
    return F.bit_count(v)


def monomials(size: int, degree: int) -> int:
    """How many monomials of exactly the degree there are in so many variables."""
    return math.comb(size + degree - 1, degree)
