"""Networks of layers: a layer looks at receptive fields of the one before and trains all its nodes in one job.

A layer takes (sample_id, ord, features, ...) and gives the same with new
features. Its fields become rows (node_id, features); the moments of all
nodes are one grouped aggregate, the small models one broadcast. With shared
weights there is one model for all fields.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.expansions import expand
from driftline.functions.vectors import gather
from driftline.operators.estimators import Linear, map_vectors, principal_components, slow_features
from driftline.operators.moments import Moments, add_up, dimension, lists, matrix
from driftline.session import ship


def lattice(width: int, height: int, field_width: int, field_height: int, step_x: int, step_y: int) -> list[tuple[int, int]]:
    """Origins (x, y) of all fields that lie within the grid, row by row."""
    return [(x, y) for y in range(0, height - field_height + 1, step_y) for x in range(0, width - field_width + 1, step_x)]


def lattice_connections(width: int, height: int, field_width: int, field_height: int, step_x: int, step_y: int, channels: int = 1) -> list[list[int]]:
    """For each field the places of its inputs in the vector, which has channels numbers a grid point."""
    return [
        [((y + b) * width + x + a) * channels + c for b in range(field_height) for a in range(field_width) for c in range(channels)]
        for x, y in lattice(width, height, field_width, field_height, step_x, step_y)
    ]


def sparse_connections(width: int, height: int, mask: Sequence[Sequence[bool]], step: int, channels: int = 1) -> list[list[int]]:
    """Fields of the mask's shape at every step-th place; those that reach over the edge go on at the other side."""
    inside = [(a, b) for b, row in enumerate(mask) for a, on in enumerate(row) if on]
    return [[((y + b) % height * width + (x + a) % width) * channels + c for a, b in inside for c in range(channels)] for y in range(0, height, step) for x in range(0, width, step)]


def preserve_mask(size: int, spread: int) -> list[list[bool]]:
    """A dense field of the size's half in a sparse one that takes every spread-th point."""
    half = size // 2
    return [[(a < half and b < half) or (a % spread == 0 and b % spread == 0) for a in range(size)] for b in range(size)]


def doubling_sizes(width: int, first: int = 2) -> list[int]:
    """Field sizes that double until they would be over the width, the largest first."""
    out = []
    while first <= width:
        out.append(first)
        first *= 2
    return out[::-1]


@dataclass(frozen=True)
class Layer:
    """A super-node for each list of connections: expansion, slow features, clipping. None: one node that sees all."""

    connections: tuple[tuple[int, ...], ...] | None = None
    outputs: int = 10
    expansions: tuple[str, ...] = ("identity",)
    pca: int | None = None  # principal components before the expansion
    clip: float | None = 4.0
    shared: bool = False
    mode: str = "serial"
    ridge: float = 1e-6


@dataclass(frozen=True)
class Network:
    name: str
    layers: tuple[Layer, ...] = field(default_factory=tuple)

    def with_expansions(self, *names: str) -> Network:
        return replace(self, layers=tuple(replace(x, expansions=names) for x in self.layers))


@dataclass(frozen=True)
class TrainedLayer:
    spec: Layer
    before: dict[int, Linear]
    models: dict[int, Linear]
    size: int  # of a field
    wide: int  # of a field's expansion


def fields(samples: DataFrame, layer: Layer) -> DataFrame:
    """(sample_id, key, node_id, features): a row for each field of each sample."""
    if layer.connections is None:
        return samples.withColumn("node_id", F.lit(0))
    cells = F.array(*[F.struct(F.lit(k).alias("node_id"), gather(F.col("features"), c).alias("x")) for k, c in enumerate(layer.connections)])
    return samples.select(*[c for c in samples.columns if c != "features"], F.explode(cells).alias("f")).select("*", F.col("f.node_id").alias("node_id"), F.col("f.x").alias("features")).drop("f")


def _states(rows: DataFrame, group: Column, size: int, through: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> dict[int, Moments]:
    """The clustered moments of every node: pairs of samples of one group, the node's own moments less its groups' means.

    A task keeps a state for each node it sees; a hot group is shuffled as one
    sum a batch and node. through: a function of (nodes, vectors) that makes the
    vectors of the size, in the same Python worker.
    """
    ship(rows.sparkSession)
    numbers = pa.list_(pa.float64())

    def seen(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        node, x = batch.column("node_id").to_numpy(), matrix(batch)
        return node, x if through is None else through(node, x)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Moments] = {}
        for batch in batches:
            if batch.num_rows:
                node, x = seen(batch)
                for k in np.unique(node).tolist():
                    mine = x[node == k]
                    s = states.setdefault(k, Moments.zero(size))
                    s.nodes(mine)
                    s.r += len(mine)
        for s in states.values():
            s.sdd = 2 * s.sxx
        yield pa.RecordBatch.from_arrays([pa.array(list(states), pa.int32()), lists([s.flat() for s in states.values()])], ["node_id", "state"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                groups = batch.column("_g").dictionary_encode(null_encoding="encode")
                node, x = seen(batch)
                pairs = np.stack([node, groups.indices.to_numpy()], axis=1)
                cells, which = np.unique(pairs, axis=0, return_inverse=True)
                total = np.zeros((len(cells), x.shape[1]))
                np.add.at(total, which.reshape(-1), x)
                columns = [pa.array(cells[:, 0].astype(np.int32)), groups.dictionary.take(pa.array(cells[:, 1])), pa.array(np.bincount(which.reshape(-1))), pa.array(total.tolist(), numbers)]
                yield pa.RecordBatch.from_arrays(columns, ["node_id", "_g", "n", "total"])

    def less(table: pa.Table) -> pa.Table:
        total = matrix(table, "total").sum(axis=0)
        s = Moments.zero(size)
        s.sdd = np.outer(total, total) * (-2 / table.column("n").to_numpy().sum())
        return pa.table({"node_id": table.column("node_id")[:1], "state": lists([s.flat()])})

    grouped = rows.select("node_id", group.cast("string").alias("_g"), "features")
    schema = "node_id int, state array<double>"
    totals = grouped.mapInArrow(sums, "node_id int, _g string, n long, total array<double>")
    partials = grouped.mapInArrow(own, schema).union(totals.groupBy("node_id", "_g").applyInArrow(less, schema))
    found = add_up(partials, "node_id").toArrow()
    return {k: Moments.of(v.values.to_numpy(zero_copy_only=False), size) for k, v in zip(found.column("node_id").to_pylist(), found.column("state"), strict=True)}


def train_layer(samples: DataFrame, layer: Layer, group: str) -> TrainedLayer:
    """group: the column whose equal values tie samples (a class, or a block of the order)."""
    rows = fields(samples, layer)
    if layer.shared:
        rows = rows.withColumn("node_id", F.lit(0))
    field = size = len(layer.connections[0]) if layer.connections else dimension(samples)
    before: dict[int, Linear] = {}
    if layer.pca:
        before = {k: principal_components(s, layer.pca) for k, s in _states(rows, F.col(group), size).items()}
        rows = _by_node(rows, before)
        size = min(layer.pca, size)
    wide = rows.withColumn("features", expand(F.col("features"), size, *layer.expansions))
    width = expanded_size(samples.sparkSession, size, layer.expansions)
    return TrainedLayer(layer, before, {k: slow_features(s, layer.outputs, layer.ridge) for k, s in _states(wide, F.col(group), width).items()}, field, width)


def expanded_size(spark: SparkSession, size: int, expansions: Sequence[str]) -> int:
    """How long the expansions of a vector of so many components are; no sample is looked at."""
    return spark.range(1).select(F.size(expand(F.array_repeat(F.lit(0.5), size), size, *expansions))).first()[0]


def _by_node(rows: DataFrame, models: dict[int, Linear]) -> DataFrame:
    one = next(iter(models.values())) if set(models) == {0} else None

    def run(x: np.ndarray) -> np.ndarray:
        if one is not None:
            return one(x[:, 1:])
        node = x[:, 0].astype(int)
        out = np.zeros((len(x), next(iter(models.values())).weights.shape[1]))
        for k, m in models.items():
            out[node == k] = m(x[node == k, 1:])
        return out

    return map_vectors(rows.withColumn("_x", F.concat(F.array(F.col("node_id").cast("double")), F.col("features"))), run, "_x", "features").drop("_x")


def apply_layer(samples: DataFrame, trained: TrainedLayer) -> DataFrame:
    """samples with features: the outputs of all nodes, node by node. One row stays one row: nothing is shuffled."""
    spec = trained.spec
    connections = spec.connections or (None,)
    n = range(len(connections))
    of = lambda found: [found[0 if spec.shared else k] for k in n]

    def side_by_side(models: list[Linear], width: int):
        return lambda x: np.concatenate([m(x[:, k * width : (k + 1) * width]) for k, m in enumerate(models)], axis=1)

    size = trained.size
    out = samples.withColumn("_all", F.concat(*[F.col("features") if c is None else gather(F.col("features"), c) for c in connections]))
    if trained.before:
        out = map_vectors(out, side_by_side(of(trained.before), size), "_all", "_all")
        size = min(spec.pca, size)
    out = out.withColumn("_all", F.concat(*[expand(F.slice("_all", k * size + 1, size), size, *spec.expansions) for k in n]))
    last = side_by_side(of(trained.models), trained.wide)
    return map_vectors(out, last if spec.clip is None else lambda x: np.clip(last(x), -spec.clip, spec.clip), "_all", "features").drop("_all")


def with_more_features(samples: DataFrame, more: DataFrame) -> DataFrame:
    """samples whose vectors go on with those of more (sample_id, features); a sample that more does not have raises when it is read."""
    added = more.select("sample_id", F.col("features").alias("_more"))
    joined = samples.join(added, "sample_id", "left")
    there = F.when(F.col("_more").isNull(), F.raise_error(F.concat(F.lit("no further features for sample "), F.col("sample_id").cast("string")))).otherwise(F.col("_more"))
    return joined.withColumn("features", F.concat("features", there)).drop("_more")


def with_more_connections(layer: Layer, inputs: int, more: int) -> Layer:
    """layer whose every field also sees the more components that stand after its inputs."""
    if layer.connections is None:
        return layer
    return replace(layer, connections=tuple((*c, *range(inputs, inputs + more)) for c in layer.connections))


def train_network(samples: DataFrame, network: Network, group: str) -> tuple[list[TrainedLayer], DataFrame]:
    """The trained layers, and samples with the last one's features."""
    trained = []
    for layer in network.layers:
        trained.append(train_layer(samples, layer, group))
        samples = apply_layer(samples, trained[-1])
    return trained, samples


def _square(side: int, fields_: int, channels: int = 1) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(c) for c in lattice_connections(side, side, fields_, fields_, fields_, fields_, channels))


#: Presets, by name; an 8 x 8 input for those of several layers.
NETWORKS = {
    "void": Network("void"),
    "sfa_1layer": Network("sfa_1layer", (Layer(None, 10),)),
    "quadratic_1layer": Network("quadratic_1layer", (Layer(None, 10, ("identity", "QT"), pca=12),)),
    "two_layers": Network("two_layers", (Layer(_square(8, 4), 6, ("identity", "u08")), Layer(None, 9, ("identity", "u08")))),
    "shared_two_layers": Network("shared_two_layers", (Layer(_square(8, 4), 6, shared=True), Layer(None, 9))),
    "three_layers": Network("three_layers", (Layer(_square(8, 2), 3), Layer(_square(4, 2, 3), 6), Layer(None, 9))),
}
