"""Number, mean, least and most of each place of a long expansion, without a row for each number.

A task expands some rows at a time, one leading component after another, and
keeps four numbers a place; only those are shuffled. Rows that are no whole
vectors of finite numbers go through the expansion's columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.expansions import EXPONENTS, expand
from driftline.operators.moments import lists, matrix
from driftline.session import ship

#: Rows that are expanded at a time.
ROWS = 256


def factors(name: str, x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray | None]]:
    """(degree, vectors, factor) of each part of an expansion into monomials: those of the degree of the vectors (size, rows), times the factor of each row."""
    if name in ("QT", "CT"):
        return [("QC".index(name[0]) + 2, x, None)]
    degree, kind, d = "SQC".index(name[0]) + 1, (name.removesuffix("_exp").split("_") + ["AP"])[1], EXPONENTS[name]
    d = d / degree if name in ("Q_exp", "C_exp") else d
    z, factor, away = x, None, np.abs(x)
    if kind == "AP":
        z = np.sign(x) * away**d
    elif kind in ("AN", "AE"):
        z = x / (1.0 + (away**d if kind == "AN" else np.exp(d * away)))
    else:
        size = np.sqrt((x * x).sum(axis=0) / len(x))
        factor = 1 / (1.0 + (size**d if kind == "N" else np.exp(d * size)))
    if not name.endswith("_exp"):
        return [(degree, z, factor)]
    plain = name == "C_AN_exp"  # there only the vector itself is normalised
    return [(1, z, factor), *[(g, x if plain else z, factor) for g in range(2, degree + 1)]]


def told(name: str) -> bool:
    """Whether factors knows the expansion."""
    return name in ("QT", "CT") or (name in EXPONENTS and name[0] in "QC")


def pieces(degree: int, z: np.ndarray, factor: np.ndarray | None) -> Iterator[np.ndarray]:
    """The monomials of a degree up to 3 of vectors (size, rows), in order of their places, some places at a time."""
    times = (lambda y: y) if factor is None else (lambda y: y * factor)
    if degree == 1:
        yield times(z)
        return
    pairs = [z[k] * z[k:] for k in range(len(z))]
    if degree == 2:
        yield from (times(p) for p in pairs)
        return
    quadratic, start = np.concatenate(pairs), 0
    for k in range(len(z)):
        yield times(z[k] * quadratic[start:])
        start += len(pairs[k])


def place_moments(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(k, n, mean, low, high) of each place of the expansion of rows (features)."""
    ship(rows.sparkSession)
    whole = (F.size("features") == size) & F.forall("features", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    whole = F.coalesce(whole, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, state = 0, None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                x = np.ascontiguousarray(matrix(batch.slice(start, ROWS)).T)
                made = [(y.sum(axis=1), y.min(axis=1), y.max(axis=1)) for part in factors(name, x) for y in pieces(*part)]
                total, low, high = (np.concatenate(c) for c in zip(*made, strict=True))
                n += x.shape[1]
                state = (total, low, high) if state is None else (state[0] + total, np.minimum(state[1], low), np.maximum(state[2], high))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), *[lists([c]) for c in state]], ["n", "total", "low", "high"])

    sums = rows.where(whole).select("features").mapInArrow(run, "n long, total array<double>, low array<double>, high array<double>")
    sums = sums.select("n", F.posexplode(F.arrays_zip("total", "low", "high")).alias("k", "x")).select("k", "n", F.col("n").alias("held"), "x.total", "x.low", "x.high")
    others = rows.where(~whole).select(F.posexplode(expand(F.col("features"), size, name)).alias("k", "v")).groupBy("k")
    others = others.agg(F.count("*").alias("n"), F.count("v").alias("held"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    return sums.union(others).groupBy("k").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("held")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))
