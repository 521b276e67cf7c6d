"""Layers whose slots hold any class of trainable node.

A slot's class learns from moments (or bounds) that add up, so all fields of a
layer are trained in one grouped pass for each slot, one slot after another:
principal components, order, expansion, reduction and the last node. A class
declares its parameters by the arguments of its ``fit``; a layer's parameters go
to those that declare them.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.expansions import expand
from driftline.functions.vectors import gather
from driftline.operators.estimators import Linear, map_vectors, principal_components, regression, slow_features
from driftline.operators.moments import Moments, dimension
from driftline.plans.network import _states, expanded_size, fields


class Model(Protocol):
    def __call__(self, x: np.ndarray) -> np.ndarray: ...


class NodeClass(Protocol):
    """fit(state, **declared) makes a model from the clustered moments of a field; the parameters it names are what it declares."""

    @staticmethod
    def fit(state: Moments) -> Model: ...


class Identity:
    @staticmethod
    def fit(state: Moments) -> Linear:
        n = len(state.sx)
        return Linear(np.zeros(n), np.eye(n), np.ones(n))


class PrincipalComponents:
    @staticmethod
    def fit(state: Moments, outputs: int | float | None = None) -> Linear:
        return principal_components(state, outputs)


class Whitening:
    @staticmethod
    def fit(state: Moments, outputs: int | float | None = None) -> Linear:
        return principal_components(state, outputs, whiten=True)


class SlowFeatures:
    @staticmethod
    def fit(state: Moments, outputs: int | None = None, ridge: float = 0.0) -> Linear:
        return slow_features(state, outputs, ridge)


class Ordering:
    """Components by how slow they are by themselves (or by variance), the slowest (largest) first; ties stay in place."""

    @staticmethod
    def fit(state: Moments, order_by: str = "delta") -> Linear:
        _, cov, slow = state.fix()
        if order_by not in ("delta", "variance"):
            raise ValueError(f"components are not ordered by {order_by}")
        var = np.diag(cov)
        key = np.where(var > 1e-300, np.diag(slow) / np.maximum(var, 1e-300), np.inf) if order_by == "delta" else -var
        return Linear(np.zeros(len(var)), np.eye(len(var))[:, np.argsort(key, kind="stable")], np.sort(key))


@dataclass(frozen=True)
class Preserved:
    """Slow features of all inputs, then principal components of what they do not tell of the first ones."""

    slow: Linear
    back: Linear
    rest: Linear
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = self.slow(x)
        return np.concatenate([y * self.scale, self.rest(x[:, : len(self.back.shift)] - self.back(y))], axis=1)


class InformationPreserving:
    """kept inputs: those before the expansion, which must begin with them (identity first). All follows from one state: the slow part is linear in what the moments are of."""

    @staticmethod
    def fit(state: Moments, kept: int, outputs: int | None = None, delta_threshold: float | int = 1.95, ridge: float = 0.0) -> Preserved:
        mean, cov, _ = state.fix()
        slow = slow_features(state, None, ridge)
        most = min(len(slow.values), outputs or kept)
        if isinstance(delta_threshold, int) and delta_threshold > most:
            raise ValueError(f"{delta_threshold} slow features of at most {most}")
        keep = delta_threshold if isinstance(delta_threshold, int) else min(int((slow.values <= delta_threshold).sum()), most)
        slow = slow.cut(keep)
        lift = np.concatenate([slow.weights, np.eye(len(mean))[:, :kept]], axis=1)  # (slow part, inputs) from the state's vector
        joint = lift.T @ cov @ lift
        centre = np.concatenate([np.zeros(keep), mean[:kept]])
        n = len(joint)
        both = Moments(1.0, 1.0, centre, joint + np.outer(centre, centre), np.zeros((n, n)))
        back = regression(both, keep) if keep else Linear(np.zeros(0), np.zeros((0, kept)), np.zeros(kept), mean[:kept])
        left = joint[keep:, keep:] - back.weights.T @ joint[:keep, :keep] @ back.weights
        rest = principal_components(Moments(1.0, 1.0, np.zeros(kept), left, np.zeros((kept, kept))), (outputs or kept) - keep)
        return Preserved(slow, back, rest, np.sqrt((back.weights**2).sum(axis=1)))


CLASSES: dict[str, type] = {c.__name__: c for c in (Identity, PrincipalComponents, Whitening, SlowFeatures, Ordering, InformationPreserving)}


def register(name: str, node: type) -> None:
    """Makes a node class known by a name."""
    CLASSES[name] = node


def declared(node: type) -> set[str]:
    return {p for k, p in enumerate(inspect.signature(node.fit).parameters) if k}


@dataclass(frozen=True)
class SlotLayer:
    """connections as in Layer; the classes of the slots before (pca, order) and after the expansion (reduction, last), None for an empty one; parameters of all slots, and of single ones by the slot's name, which go before."""

    connections: tuple[tuple[int, ...], ...] | None = None
    pca: str | None = None
    order: str | None = None
    expansions: tuple[str, ...] | None = None
    reduction: str | None = None
    last: str | None = "SlowFeatures"
    parameters: Mapping[str, object] = field(default_factory=dict)
    shared: bool = False


SLOTS = ("pca", "order", "expansion", "reduction", "last")


def routed(layer: SlotLayer, slot: str, **given: object) -> dict[str, object]:
    """The parameters of a slot: those that its class declares, of the slot's own, of the layer and of given ones. A name that no slot declares raises."""
    every = [CLASSES[getattr(layer, s)] for s in SLOTS if s != "expansion" and getattr(layer, s)]
    common = {k: v for k, v in layer.parameters.items() if k not in SLOTS}
    unknown = [k for k in common if not any(k in declared(c) for c in every)]
    wants = declared(CLASSES[getattr(layer, slot)])
    own = dict(layer.parameters.get(slot, {}))
    if unknown or set(own) - wants:
        raise ValueError(f"no node declares {', '.join(sorted({*unknown, *(set(own) - wants)}))}")
    return {k: v for k, v in {**given, **common, **own}.items() if k in wants}


@dataclass(frozen=True)
class TrainedSlots:
    spec: SlotLayer
    size: int
    steps: tuple[tuple[str, dict[int, Model]], ...]  # of each filled slot, the models by field; the expansion has none
    widths: tuple[int, ...]  # the size of a field's vector before each step


def _through(chain: Sequence[dict[int, Model]]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The models of some slots, one slot after another, as a function of (fields, vectors)."""

    def run(node: np.ndarray, x: np.ndarray) -> np.ndarray:
        for models in chain:
            out = None
            for k, m in models.items():
                y = m(x[node == k])
                out = np.zeros((len(x), y.shape[1])) if out is None else out
                out[node == k] = y
            x = out
        return x

    return run


def _mapped(rows: DataFrame, chain: Sequence[dict[int, Model]]) -> DataFrame:
    if not chain:
        return rows
    through = _through(chain)
    return map_vectors(rows.withColumn("_x", F.concat(F.array(F.col("node_id").cast("double")), F.col("features"))), lambda x: through(x[:, 0].astype(int), x[:, 1:]), "_x", "features").drop("_x")


def train_slots(samples: DataFrame, layer: SlotLayer, group: str) -> TrainedSlots:
    """Trains the slots of all fields, one grouped pass a slot. group: the column whose equal values tie samples.

    Models between two expansions work in one Python worker, the last ones in
    that of the pass itself: a task never holds more than two, whatever the slots.
    """
    rows = fields(samples, layer)
    if layer.shared:
        rows = rows.withColumn("node_id", F.lit(0))
    field_size = size = len(layer.connections[0]) if layer.connections else dimension(samples)
    steps, widths, kept, chain = [], [], size, []
    for slot in SLOTS:
        if slot == "expansion":
            kept = size
            if layer.expansions:
                steps.append((slot, {}))
                widths.append(size)
                rows = _mapped(rows, chain).withColumn("features", expand(F.col("features"), size, *layer.expansions))
                chain = []
                size = expanded_size(samples.sparkSession, size, layer.expansions)
            continue
        name = getattr(layer, slot)
        if name is None:
            continue
        node = CLASSES[name]
        options = routed(layer, slot, kept=kept)
        models = {k: node.fit(s, **options) for k, s in _states(rows, F.col(group), size, _through(chain) if chain else None).items()}
        steps.append((slot, models))
        widths.append(size)
        size = next(iter(models.values()))(np.zeros((1, size))).shape[1]
        chain = [*chain, models]
    return TrainedSlots(layer, field_size, tuple(steps), tuple(widths))


def apply_slots(samples: DataFrame, trained: TrainedSlots) -> DataFrame:
    """samples with features: the outputs of all fields side by side. One row stays one row."""
    spec = trained.spec
    connections = spec.connections or (None,)
    n = len(connections)
    out = samples.withColumn("_all", F.concat(*[F.col("features") if c is None else gather(F.col("features"), c) for c in connections]))

    def side_by_side(models: list[Model], width: int):
        return lambda x: np.concatenate([m(x[:, k * width : (k + 1) * width]) for k, m in enumerate(models)], axis=1)

    def mapped(rows: DataFrame, chain: list) -> DataFrame:
        return map_vectors(rows, lambda x: functools.reduce(lambda y, fn: fn(y), chain, x), "_all", "_all") if chain else rows

    chain = []
    for (slot, models), width in zip(trained.steps, trained.widths, strict=True):
        if slot == "expansion":
            out, chain = mapped(out, chain), []
            out = out.withColumn("_all", F.concat(*[expand(F.slice("_all", k * width + 1, width), width, *spec.expansions) for k in range(n)]))
        else:
            chain.append(side_by_side([models[0 if spec.shared else k] for k in range(n)], width))
    return mapped(out, chain).withColumn("features", F.col("_all")).drop("_all")
