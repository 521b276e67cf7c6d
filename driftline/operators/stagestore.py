"""Trained stages and their outputs, found again by what went into them.

The name of a stage is a digest of its input's rows and of its specification;
a row or a parameter that differs gives another name. Names of later layers
follow from those of earlier ones, so a network that is there is read without
looking at a sample but those of its first input.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import fields, is_dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.saving import load, save
from driftline.plans.network import Layer, Network, TrainedLayer, apply_layer, train_layer


def _hashable(rows: DataFrame) -> list[Column]:
    """The columns in order of their names; maps, which have no order, as sorted entries."""
    return [F.sort_array(F.map_entries(c)) if rows.schema[c].dataType.typeName() == "map" else F.col(f"`{c}`") for c in sorted(rows.columns)]


def content_digest(rows: DataFrame) -> str:
    """A digest of a table's rows in any order, repeated ones as often as they stand, and of its columns' names and types. One aggregate."""
    cells = _hashable(rows)
    total = lambda seed: F.sum(F.xxhash64(*cells, F.lit(seed)).cast("decimal(38,0)"))
    found = rows.agg(F.count("*"), total(1), total(2), F.bit_xor(F.xxhash64(*cells, F.lit(3)))).first()
    kinds = sorted((f.name, f.dataType.simpleString()) for f in rows.schema.fields)
    return hashlib.sha256(repr((kinds, *map(str, found))).encode()).hexdigest()


def spec_digest(x: object) -> str:
    """A digest of plain values, arrays, data classes, functions by name, and lists, tuples and dictionaries (in any order) of them. Others raise."""
    return hashlib.sha256(repr(_canonical(x)).encode()).hexdigest()


def _canonical(x: object) -> object:
    if is_dataclass(x) and not isinstance(x, type):
        return ("data", type(x).__qualname__, tuple((f.name, _canonical(getattr(x, f.name))) for f in fields(x)))
    if isinstance(x, np.ndarray):
        return ("array", x.shape, str(x.dtype), hashlib.sha256(np.ascontiguousarray(x).tobytes()).hexdigest())
    if isinstance(x, dict):
        return ("dict", tuple(sorted((repr(_canonical(k)), _canonical(v)) for k, v in x.items())))
    if isinstance(x, (list, tuple)):
        return ("list", tuple(_canonical(v) for v in x))
    if isinstance(x, (set, frozenset)):
        return ("set", tuple(sorted(repr(_canonical(v)) for v in x)))
    if isinstance(x, np.generic):
        return _canonical(x.item())
    if x is None or isinstance(x, (bool, int, float, str, bytes)):
        return (type(x).__name__, repr(x))
    if isinstance(x, type) or callable(x) and getattr(x, "__name__", "<lambda>") != "<lambda>":
        return ("function", x.__module__, x.__qualname__)
    raise TypeError(f"{type(x).__name__} has no digest")


class StageStore:
    """A folder of Parquet tables, each named by its kind and the digest of what made it.

    A table appears under its name only when it is complete; two sessions that
    make the same one leave either's.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        #: What was read and what was made, by kind and name.
        self.log: list[tuple[str, str, str]] = []

    def _path(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def holds(self, kind: str, name: str) -> bool:
        where, fs = self._path(f"{self.folder}/{kind}-{name}/_SUCCESS")
        return bool(fs.exists(where))

    def through(self, kind: str, name: str, make: Callable[[str], None]) -> str:
        """The path of a table; make writes it to the path it is given, unless it is there."""
        path = f"{self.folder}/{kind}-{name}"
        if self.holds(kind, name):
            self.log.append(("read", kind, name))
            return path
        draft = f"{self.folder}/draft-{uuid.uuid4().hex}"
        make(draft)
        where, fs = self._path(path)
        source, _ = self._path(draft)
        if fs.exists(where) or not fs.rename(source, where):
            fs.delete(source, True)
        self.log.append(("made", kind, name))
        return path

    def model(self, name: str, make: Callable[[], object]) -> object:
        return load(self.spark, self.through("model", name, lambda path: save(self.spark, make(), path)))

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.spark.read.parquet(self.through("table", name, lambda path: make().write.parquet(path)))

    def forget(self, kind: str, name: str) -> None:
        where, fs = self._path(f"{self.folder}/{kind}-{name}")
        fs.delete(where, True)


def layer_through(store: StageStore, samples: DataFrame, name: str, layer: Layer, group: str) -> tuple[TrainedLayer, DataFrame, str]:
    """The trained layer, samples with its features, and their name; name: that of samples."""
    made = spec_digest(("layer", name, layer, group))
    trained = store.model(made, lambda: train_layer(samples, layer, group))
    return trained, store.table(made, lambda: apply_layer(samples, trained)), made


def network_through(store: StageStore, samples: DataFrame, network: Network, group: str) -> tuple[list[TrainedLayer], DataFrame]:
    """As train_network, but stages that the store holds are read; those that it does not hold are trained, and then held."""
    name, trained = content_digest(samples), []
    for layer in network.layers:
        one, samples, name = layer_through(store, samples, name, layer, group)
        trained.append(one)
    return trained, samples


def applied_through(store: StageStore, samples: DataFrame, trained: list[TrainedLayer]) -> DataFrame:
    """New samples through trained layers; outputs that the store holds are read."""
    name = content_digest(samples)
    for layer in trained:
        name = spec_digest(("applied", name, layer))
        samples = store.table(name, lambda s=samples, t=layer: apply_layer(s, t))
    return samples
