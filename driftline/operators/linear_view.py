"""What a trained model keeps of its input as far as a linear map can tell, and how sensitive that map is."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.estimators import Linear, map_vectors, regression
from driftline.operators.moments import Moments, dimension, merge, unlabelled


@dataclass(frozen=True)
class LinearView:
    """back: the regression of the input on the outputs; explained: the share of the input's variance that it gives back; sensitivity: of each output, the squared length of what a step of 1 changes in the input; influence: of each input component, the variance of the outputs that a linear map takes from it alone."""

    back: Linear
    explained: float
    sensitivity: np.ndarray
    influence: np.ndarray


def linear_view(samples: DataFrame, outputs: str | Column = "outputs", inputs: str | Column = "features", ridge: float = 0.0) -> LinearView:
    """samples: rows with both vectors. One pass of joint moments; components that depend on others take the least solution."""
    joint = samples.select(F.concat(outputs, inputs).alias("features"))
    size, count = dimension(joint), dimension(samples.select((F.col(outputs) if isinstance(outputs, str) else outputs).alias("features")))
    return view_of(merge(unlabelled(joint, size), size), count, ridge)


def view_of(joint: Moments, outputs: int, ridge: float = 0.0) -> LinearView:
    back = regression(joint, outputs, ridge)
    _, cov, _ = joint.fix()
    own, cross, inner = cov[:outputs, :outputs], cov[:outputs, outputs:], cov[outputs:, outputs:]
    left = np.trace(inner) - 2 * np.trace(back.weights.T @ cross) + np.trace(back.weights.T @ own @ back.weights)
    there = np.linalg.lstsq(inner, cross.T, rcond=1e-12)[0]  # the outputs on the inputs
    return LinearView(back, 1 - left / np.trace(inner), (back.weights**2).sum(axis=1), (there**2).sum(axis=1) * np.diag(inner))


def approximate(samples: DataFrame, view: LinearView, outputs: str = "outputs", out: str = "approximated") -> DataFrame:
    """samples with the input that the linear map gives for the outputs."""
    return map_vectors(samples, view.back, outputs, out)


def residual(samples: DataFrame, approximated: str = "approximated", inputs: str = "features") -> Column:
    """The difference of the input and what stands for it, as a column."""
    return F.zip_with(inputs, approximated, lambda a, b: a - b)


# Probes of what a residual still tells.


def probe_bases(size: int, counts: list[int], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of random sigmoids, as many as the largest count; a lesser count takes the first ones."""
    rng = np.random.default_rng(seed)
    most = max(counts)
    return rng.normal(size=(size, most)) / np.sqrt(size), rng.normal(size=most)


def probe(samples: DataFrame, target: Column, counts: list[int], seed: int = 0, ridge: float = 1e-9) -> DataFrame:
    """(basis, explained, mse): how well the target (a number) is told by regression on the first so many of a set of random sigmoids of features (standardised by the caller), beside features themselves (basis 0).

    All sizes come from nested blocks of one moment matrix, in one pass.
    """
    size = dimension(samples)
    w, o = probe_bases(size, counts, seed)
    most = w.shape[1]
    rows = samples.select(F.concat(F.array(target.cast("double")), "features").alias("features"))
    wide = map_vectors(rows, lambda x: np.concatenate([x[:, 1:], np.tanh(x[:, 1:] @ w + o), x[:, :1]], axis=1))
    joint = merge(unlabelled(wide, size + most + 1), size + most + 1)
    _, cov, _ = joint.fix()
    whole = cov[-1, -1]
    found = []
    for count in [0, *counts]:
        at = np.arange(size + count)
        own, cross = cov[np.ix_(at, at)], cov[at, -1]
        fitted = np.linalg.lstsq(own + ridge * np.diag(np.diag(own)), cross, rcond=1e-12)[0]
        left = float(whole - 2 * fitted @ cross + fitted @ own @ fitted)
        found.append((count, 1 - left / float(whole) if whole > 0 else 0.0, left))
    return samples.sparkSession.createDataFrame(found, "basis int, explained double, mse double")


def probe_classes(samples: DataFrame, counts: list[int], key: str = "class", seed: int = 0, ridge: float = 1e-6) -> DataFrame:
    """(basis, rate): the share of samples whose class the Gaussian head tells from the first so many random sigmoids of features. The heads of all sizes come from one pass of class moments, the rates from another."""
    from driftline.operators.heads import class_states, gaussian_of

    size = dimension(samples)
    w, o = probe_bases(size, counts, seed)
    wide = map_vectors(samples.where(F.col(key).isNotNull()).select(F.col(key).cast("int").alias("class"), "features"), lambda x: np.tanh(x @ w + o))
    states = class_states(wide, w.shape[1], "class")
    cut = lambda s, n: Moments(s.q, s.r, s.sx[:n], s.sxx[:n, :n], s.sdd[:n, :n])
    heads = [(n, gaussian_of({k: cut(s, n) for k, s in states.items()}, ridge)) for n in counts]
    names = np.array(list(states))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, rows = np.zeros(len(heads), np.int64), 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
                rows += len(x)
                for k, (n, head) in enumerate(heads):
                    right[k] += int((names[head(x[:, :n]).argmax(axis=1)] == batch.column("class").to_numpy()).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in heads], pa.int32()), pa.array(right), pa.array([rows] * len(heads), pa.int64())], ["basis", "right", "n"])

    return wide.mapInArrow(run, "basis int, right long, n long").groupBy("basis").agg((F.sum("right") / F.sum("n")).alias("rate"))
