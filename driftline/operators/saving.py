"""Models and networks that outlive a session: a Parquet table with a row for each of their arrays and values."""

from __future__ import annotations

from dataclasses import fields, is_dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from driftline.operators.cutoff import CutOff
from driftline.operators.estimators import Linear, SlowAndRest
from driftline.operators.linear_view import LinearView
from driftline.operators.moments import Moments
from driftline.operators.selection import AdaptedSigmoids
from driftline.plans.network import Layer, TrainedLayer
from driftline.plans.slots import Preserved, SlotLayer, TrainedSlots

#: What may be saved, by name.
KINDS = {c.__name__: c for c in (Linear, SlowAndRest, Moments, Layer, TrainedLayer, CutOff, LinearView, AdaptedSigmoids, Preserved, SlotLayer, TrainedSlots)}
_SCHEMA = "path string, kind string, value string, shape array<int>, numbers array<double>"


def _rows(x: object, path: str) -> list[tuple]:
    if is_dataclass(x):
        if KINDS.get(type(x).__name__) is not type(x):
            raise TypeError(f"{type(x).__name__} is not a model that can be saved")
        return [(path, "model", type(x).__name__, None, None)] + [r for f in fields(x) for r in _rows(getattr(x, f.name), f"{path}/{f.name}")]
    if isinstance(x, (list, tuple)):
        return [(path, type(x).__name__, str(len(x)), None, None)] + [r for k, v in enumerate(x) for r in _rows(v, f"{path}/{k}")]
    if isinstance(x, dict):
        return [(path, "dict", str(len(x)), None, None)] + [r for k, (a, v) in enumerate(x.items()) for r in (*_rows(a, f"{path}/{k}/key"), *_rows(v, f"{path}/{k}/value"))]
    if isinstance(x, np.ndarray):
        return [(path, "array", None, list(x.shape), x.astype(float).reshape(-1).tolist())]
    if x is None:
        return [(path, "none", None, None, None)]
    if isinstance(x, (bool, int, float, str, np.integer, np.floating)):
        plain = x.item() if isinstance(x, (np.integer, np.floating)) else x
        return [(path, type(plain).__name__, repr(plain) if isinstance(plain, float) else str(plain), None, None)]
    raise TypeError(f"{type(x).__name__} at {path} can not be saved")


def as_table(spark: SparkSession, model: object) -> DataFrame:
    return spark.createDataFrame(_rows(model, ""), _SCHEMA)


def save(spark: SparkSession, model: object, path: str) -> None:
    """model: a model of KINDS, or lists, tuples and dictionaries of them. A path that exists raises."""
    as_table(spark, model).coalesce(1).write.parquet(path)


def of_table(table: DataFrame) -> object:
    held = {r["path"]: r for r in table.select("path", "kind", "value", "shape", "numbers").collect()}  # models are small

    def made(path: str) -> object:
        r = held[path]
        kind, value = r["kind"], r["value"]
        if kind == "model":
            return KINDS[value](**{f.name: made(f"{path}/{f.name}") for f in fields(KINDS[value])})
        if kind in ("list", "tuple"):
            return (list if kind == "list" else tuple)(made(f"{path}/{k}") for k in range(int(value)))
        if kind == "dict":
            return {made(f"{path}/{k}/key"): made(f"{path}/{k}/value") for k in range(int(value))}
        if kind == "array":
            return np.array(r["numbers"], float).reshape(r["shape"])
        return {"none": lambda _: None, "bool": lambda v: v == "True", "int": int, "float": float, "str": str}[kind](value)

    return made("")


def load(spark: SparkSession, path: str) -> object:
    return of_table(spark.read.schema(_SCHEMA).parquet(path))
