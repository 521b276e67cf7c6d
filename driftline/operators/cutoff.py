"""Cut-off at the bounds of training under several rotations, and how unusual a sample is.

The bounds of all rotations are one aggregate of a few arrays a task. A sample
that is clipped gets a correction factor below 1, and how likely its components
are under wide normal curves is a second factor; both are columns beside the
features, and several cut-offs of a network multiply into them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.moments import dimension, matrix
from driftline.session import ship

#: The share of an interval by which a value is out that takes a factor to 3/4, and how much wider than training the normal curves are.
SOFTNESS, WIDER = 0.15, 4.0


@dataclass(frozen=True)
class CutOff:
    """Rotations (matrices that x is multiplied by from the right), the bounds of training under each, and the mean and spread of x."""

    rotations: tuple[np.ndarray, ...]
    low: tuple[np.ndarray, ...]
    high: tuple[np.ndarray, ...]
    mean: np.ndarray
    spread: np.ndarray

    def clip(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x within the bounds of one rotation after another, the correction factor and the logarithm of the normal factor of each row.

        A component that is constant in training counts as out by any
        difference, and its normal factor is left out.
        """
        factor, log_normal = np.ones(len(x)), np.zeros(len(x))
        wide = WIDER * self.spread
        some = wide > 0
        for turn, low, high in zip(self.rotations, self.low, self.high, strict=True):
            y = x @ turn
            cut = np.clip(y, low, high)
            width = np.abs(high - low)
            out = np.abs(cut - y)
            share = np.where(width > 0, out / np.where(width > 0, width, 1), np.where(out > 1e-12 * np.maximum(np.abs(high), 1), np.inf, 0.0))
            gone = np.where(np.isinf(share), 1.0, share / (np.where(np.isinf(share), 0.0, share) + SOFTNESS))
            factor = factor * (1 - gone**2).prod(axis=1)
            z = (x[:, some] - self.mean[some]) / wide[some]
            log_normal = log_normal - (0.5 * z**2 + np.log(wide[some] * np.sqrt(2 * np.pi))).sum(axis=1)
            x = cut @ turn.T
        return x, factor, log_normal


def random_rotations(size: int, count: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    """The identity, then orthogonal matrices drawn evenly: the same for the same seed."""
    rng = np.random.default_rng(seed)
    out = [np.eye(size)][:count]
    for _ in range(1, count):
        q, r = np.linalg.qr(rng.normal(size=(size, size)))
        out.append(q * np.sign(np.diag(r)))
    return tuple(out)


def fit_cut_off(samples: DataFrame, rotations: int | tuple[np.ndarray, ...] = 1, seed: int = 0) -> CutOff:
    """From samples (features): a number of random rotations, of which the first is none, or the given ones. One pass; no samples raise."""
    size = dimension(samples)
    turns = random_rotations(size, rotations, seed) if isinstance(rotations, int) else tuple(rotations)
    ship(samples.sparkSession)
    n = len(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, sums = np.full((n, size), np.inf), np.full((n, size), -np.inf), np.zeros((2, size))
        rows = 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                rows += len(x)
                sums += np.stack([x.sum(axis=0), (x**2).sum(axis=0)])
                for k, turn in enumerate(turns):
                    y = x @ turn
                    low[k], high[k] = np.minimum(low[k], y.min(axis=0)), np.maximum(high[k], y.max(axis=0))
        if rows:
            cells = np.concatenate([low.reshape(-1), high.reshape(-1), sums.reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells), pa.array(np.full(len(cells), rows))], ["cell", "x", "n"])

    parts = samples.select("features").mapInArrow(run, "cell int, x double, n long")
    bounds = n * size
    found = parts.groupBy("cell").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.sum("x").alias("s"), F.sum("n").alias("n")).toArrow()
    by = np.argsort(found.column("cell").to_numpy())
    a, b, s, rows = (found.column(c).to_numpy()[by] for c in ("a", "b", "s", "n"))
    mean = s[2 * bounds : 2 * bounds + size] / rows[0]
    square = s[2 * bounds + size :] / rows[0]
    return CutOff(turns, tuple(a[:bounds].reshape(n, size)), tuple(b[bounds : 2 * bounds].reshape(n, size)), mean, np.sqrt(np.maximum(square - mean**2, 0)))


def apply_cut_off(samples: DataFrame, model: CutOff, only_measure: bool = False) -> DataFrame:
    """samples with features clipped (unless only measured), and with correction and log_normal: those that are there already, times (plus) this cut-off's."""
    ship(samples.sparkSession)
    given = samples
    for name, plain in (("correction", 1.0), ("log_normal", 0.0)):
        if name not in samples.columns:
            given = given.withColumn(name, F.lit(plain))
    rest = [f for f in given.schema.fields if f.name not in ("features", "correction", "log_normal")]
    names = [f.name for f in rest]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "features array<double>, correction double, log_normal double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                y, factor, log_normal = model.clip(x)
                y = np.ascontiguousarray(x if only_measure else y)
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], made, pa.array(batch.column("correction").to_numpy() * factor), pa.array(batch.column("log_normal").to_numpy() + log_normal)], [*names, "features", "correction", "log_normal"])

    return given.mapInArrow(run, schema)


def combined(factors: list[Column], average: bool = True) -> Column:
    """One factor from those of several layers: their mean, or their product; a null one (of a layer without a cut-off) is left out, and without any the result is null."""
    there = F.filter(F.array(*factors), lambda x: x.isNotNull())
    total = F.aggregate(there, F.lit(0.0 if average else 1.0), (lambda s, x: s + x) if average else (lambda s, x: s * x))
    return F.when(F.size(there) > 0, total / F.size(there) if average else total)


def most_unusual(samples: DataFrame, count: int = 40, by: str = "correction") -> DataFrame:
    """The count samples of the least factor, the least first; ties by sample_id."""
    return samples.orderBy(by, "sample_id").limit(count)
