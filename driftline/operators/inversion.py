"""Back from features to inputs: local inverses of models and networks, and reconstruction from neighbours."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.estimators import Linear, map_vectors
from driftline.operators.moments import dimension, matrix, merge, unlabelled
from driftline.plans.network import TrainedLayer
from driftline.session import ship

Function = Callable[[np.ndarray], np.ndarray]


def numeric_expansion(names: Sequence[str]) -> Function:
    """The named expansions of a matrix in numpy: identity, QT, CT and powers. Another name raises ValueError."""

    def one(name: str) -> Function:
        if name == "identity":
            return lambda x: x
        if name in ("QT", "CT"):
            degree = 2 if name == "QT" else 3
            return lambda x: np.stack([x[:, t].prod(axis=1) for t in map(list, itertools.combinations_with_replacement(range(x.shape[1]), degree))], axis=1)
        if m := re.fullmatch(r"([us])(\d+)", name):
            p = int(m[2]) / 10 ** (len(m[2]) - 1)
            return (lambda x: np.abs(x) ** p) if m[1] == "u" else lambda x: np.sign(x) * np.abs(x) ** p
        raise ValueError(f"{name} has no local inverse here")

    parts = [one(n) for n in names]
    return lambda x: np.concatenate([f(x) for f in parts], axis=1)


def near_inverse(model: Linear, x: np.ndarray, change: np.ndarray) -> np.ndarray:
    """x moved by the least step that changes the outputs by change."""
    return x + change @ np.linalg.pinv(model.weights)


def least_squares_inverse(fn: Function, x: np.ndarray, target: np.ndarray, closeness: float = 0.5, steps: int = 12, eps: float = 1e-5) -> np.ndarray:
    """Rows z near x with fn(z) near target: the least (1 - closeness) |fn(z) - target|^2 + closeness |z - x|^2 found by damped Gauss-Newton steps.

    All rows of a batch step together; a step that would raise a row's cost is not taken.
    """
    cost = lambda z: (1 - closeness) * ((fn(z) - target) ** 2).sum(axis=1) + closeness * ((z - x) ** 2).sum(axis=1)
    z, damping, size = x.copy(), np.full(len(x), 1e-3), x.shape[1]
    now = cost(z)
    for _ in range(steps):
        shifts = np.eye(size) * eps
        slope = np.stack([(fn(z + s) - fn(z - s)) / (2 * eps) for s in shifts], axis=2)
        turned = slope.transpose(0, 2, 1)
        pull = (1 - closeness) * (turned @ (target - fn(z))[:, :, None])[:, :, 0] + closeness * (x - z)
        bend = (1 - closeness) * turned @ slope + (closeness + damping)[:, None, None] * np.eye(size)
        tried = z + np.linalg.solve(bend, pull[:, :, None])[:, :, 0]
        after = cost(tried)
        better = after < now
        z, now = np.where(better[:, None], tried, z), np.where(better, after, now)
        damping = np.where(better, damping / 4, damping * 4)
    return z


def _nodes(layer: TrainedLayer, width: int):
    """(places, before, model) of each node of a layer that sees vectors of the width."""
    spec = layer.spec
    for k, places in enumerate(spec.connections or (tuple(range(width)),)):
        key = 0 if spec.shared else k
        yield list(places), layer.before.get(key), layer.models[key]


def _clipped(layer: TrainedLayer, y: np.ndarray) -> np.ndarray:
    return y if layer.spec.clip is None else np.clip(y, -layer.spec.clip, layer.spec.clip)


def layer_forward(layer: TrainedLayer, x: np.ndarray) -> np.ndarray:
    wide = numeric_expansion(layer.spec.expansions)
    return _clipped(layer, np.concatenate([model(wide(before(x[:, at]) if before else x[:, at])) for at, before, model in _nodes(layer, x.shape[1])], axis=1))


def layer_inverse(layer: TrainedLayer, x: np.ndarray, wanted: np.ndarray, closeness: float = 0.5) -> np.ndarray:
    """Vectors near x for which the layer gives about wanted; a place that several nodes see gets the mean of what they ask for, one that none sees stays."""
    wide = numeric_expansion(layer.spec.expansions)
    total, times, start = np.zeros_like(x), np.zeros(x.shape[1]), 0
    for at, before, model in _nodes(layer, x.shape[1]):
        part = x[:, at]
        inner = before(part) if before else part
        expanded = wide(inner)
        end = start + model.weights.shape[1]
        target = near_inverse(model, expanded, wanted[:, start:end] - _clipped(layer, model(expanded)))
        start = end
        moved = target if tuple(layer.spec.expansions) == ("identity",) else least_squares_inverse(wide, inner, target, closeness)
        asked = near_inverse(before, part, moved - inner) if before else moved
        np.add.at(total, (slice(None), at), asked)
        np.add.at(times, at, 1)
    return np.where(times > 0, total / np.maximum(times, 1), x)


def network_inverse(trained: list[TrainedLayer], samples: DataFrame, wanted: Column, out: str = "inverted", closeness: float = 0.5) -> DataFrame:
    """samples with vectors near features for which the network gives about wanted: layer by layer from the last. Nothing is shuffled."""
    size = dimension(samples)

    def run(both: np.ndarray) -> np.ndarray:
        seen, target = [both[:, :size]], both[:, size:]
        for layer in trained[:-1]:
            seen.append(layer_forward(layer, seen[-1]))
        for layer, x in zip(reversed(trained), reversed(seen), strict=True):
            target = layer_inverse(layer, x, target, closeness)
        return target

    return map_vectors(samples.withColumn("_both", F.concat("features", wanted)), run, "_both", out).drop("_both")


# Reconstruction from the nearest neighbours in feature space.


def local_weights(y: np.ndarray, near: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights that sum to 1 with which the neighbours (rows, k, size) make y (rows, size) best; the ridge is a share of the neighbours' spread."""
    d = near - y[:, None, :]
    gram = d @ d.transpose(0, 2, 1)
    trace = np.trace(gram, axis1=1, axis2=2)
    gram = gram + (ridge * np.where(trace > 0, trace, 1) / near.shape[1])[:, None, None] * np.eye(near.shape[1])
    w = np.linalg.solve(gram, np.ones((len(y), near.shape[1], 1)))[:, :, 0]
    return w / w.sum(axis=1, keepdims=True)


def from_neighbours(near: DataFrame, queries: DataFrame, reference: DataFrame, kind: str = "mean", ridge: float = 1e-3) -> DataFrame:
    """(query_id, made): each query's input made of those of its neighbours, as their mean or by local linear weights.

    near (query_id, reference_id, rank): k rows a query, so a group is small.
    queries (query_id, features); reference (reference_id, features, input).
    """
    if kind not in ("mean", "linear"):
        raise ValueError(f"no reconstruction is called {kind}")
    rows = near.select("query_id", "reference_id", "rank").join(reference.select("reference_id", F.col("features").alias("_y"), "input"), "reference_id")
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "reference_id", "_y", "input"))).alias("_n"))
    both = listed.join(queries.select("query_id", "features"), "query_id")
    both = both.select("query_id", "features", F.size("_n").alias("k"), F.flatten(F.col("_n._y")).alias("ys"), F.flatten(F.col("_n.input")).alias("xs"))
    ship(near.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column("k").to_numpy()
            for k in np.unique(ks):
                some = batch.filter(pa.array(ks == k))
                y = matrix(some)
                xs = matrix(some, "xs").reshape(len(y), k, -1)
                w = np.full((len(y), k), 1 / k) if kind == "mean" else local_weights(y, matrix(some, "ys").reshape(len(y), k, -1), ridge)
                made = (w[:, :, None] * xs).sum(axis=1)
                yield pa.RecordBatch.from_arrays([some.column("query_id"), pa.array(made.tolist(), pa.list_(pa.float64()))], ["query_id", "made"])

    return both.mapInArrow(run, "query_id long, made array<double>")


def explained_by(pairs: DataFrame, truth: str, made: str) -> DataFrame:
    """(n, explained): 1 less the squared error of made vectors over the squared distance of the true ones from their mean."""
    size = dimension(pairs.select(F.col(truth).alias("features")))
    true = merge(unlabelled(pairs.select(F.col(truth).alias("features")), size), size)
    spread = float(np.trace(true.fix()[1])) * true.q
    error = F.aggregate(F.zip_with(truth, made, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    return pairs.agg(F.count("*").alias("n"), (1 - F.sum(error) / F.lit(spread)).alias("explained"))
