"""Models learnt from moments: small matrices on the driver, applied by tasks to batches of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.expansions import expand
from driftline.functions.vectors import clip_between
from driftline.operators.moments import Moments, dimension, matrix, merge, train, unlabelled
from driftline.session import ship
from driftline.staging import settled


@dataclass(frozen=True)
class Linear:
    """y = (x - mean) weights + shift; values: eigenvalues or the like, one for each output."""

    mean: np.ndarray
    weights: np.ndarray
    values: np.ndarray
    shift: np.ndarray | float = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.weights + self.shift

    def inverse(self, y: np.ndarray) -> np.ndarray:
        """The least vector that gives y, by the pseudo-inverse."""
        return (y - self.shift) @ np.linalg.pinv(self.weights) + self.mean

    def cut(self, outputs: int) -> Linear:
        return replace(self, weights=self.weights[:, :outputs], values=self.values[:outputs], shift=self.shift if np.isscalar(self.shift) else self.shift[:outputs])


def map_vectors(samples: DataFrame, fn, column: str = "features", out: str = "features") -> DataFrame:
    """samples with fn of the column's matrix in the column out; fn is sent to the tasks, so it holds small models only."""
    ship(samples.sparkSession)
    rest = [f for f in samples.schema.fields if f.name != out]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{out}` array<double>"])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = np.ascontiguousarray(fn(matrix(batch, column)))
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], made], [*names, out])

    return samples.mapInArrow(run, schema)


def _signs(weights: np.ndarray) -> np.ndarray:
    """The largest loading of each output is positive."""
    if not weights.size:
        return weights
    return weights * np.sign(weights[np.abs(weights).argmax(axis=0), np.arange(weights.shape[1])])


def slow_features(state: Moments, outputs: int | None = None, ridge: float = 0.0) -> Linear:
    """Outputs of unit variance whose differences are least, the slowest first. A covariance without full rank raises unless there is a ridge."""
    mean, cov, slow = state.fix()
    cov = cov + ridge * np.eye(len(cov))
    values, vectors = np.linalg.eigh(cov)
    if values[0] <= 1e-12 * max(values[-1], 1e-300):
        raise ValueError("the covariance is singular; give a ridge or fewer components")
    white = vectors / np.sqrt(values)
    deltas, turn = np.linalg.eigh(white.T @ slow @ white)
    if deltas[0] < -1e-9:
        raise ValueError("a negative delta: the graph has negative weights")
    return Linear(mean, _signs(white @ turn[:, :outputs]), deltas[:outputs])


def principal_components(state: Moments, outputs: int | float | None = None, whiten: bool = False) -> Linear:
    """By falling variance; outputs below 1 is the share of variance to explain."""
    mean, cov, _ = state.fix()
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    if isinstance(outputs, float) and outputs < 1:
        outputs = int(np.searchsorted(np.cumsum(values) / values.sum(), outputs - 1e-12) + 1)
    k = len(values) if outputs is None else int(outputs)
    weights = _signs(vectors[:, :k])
    return Linear(mean, weights / np.sqrt(np.maximum(values[:k], 1e-300)) if whiten else weights, values[:k])


def explained_variance(model: Linear, state: Moments) -> float:
    """The share of variance that a principal component model keeps."""
    return float(model.values.sum() / np.trace(state.fix()[1]))


def regression(joint: Moments, inputs: int, ridge: float = 0.0) -> Linear:
    """Least squares with a bias, from moments of vectors that hold inputs first and targets after."""
    mean, cov, _ = joint.fix()
    a = cov[:inputs, :inputs] + ridge * np.eye(inputs)
    weights = np.linalg.lstsq(a, cov[:inputs, inputs:], rcond=1e-12)[0]
    return Linear(mean[:inputs], weights, np.zeros(weights.shape[1]), mean[inputs:])


def fit_regression(samples: DataFrame, target: Column, ridge: float = 0.0) -> Linear:
    """samples (features); target: a number or a vector."""
    is_vector = dict(samples.select(target.alias("t")).dtypes)["t"].startswith("array")
    joint = samples.select(F.concat("features", target if is_vector else F.array(target.cast("double"))).alias("features"))
    state = train(joint, "unlabeled")
    return regression(state, dimension(samples), ridge)


@dataclass(frozen=True)
class SlowAndRest:
    """Information-preserving slow features: slow ones of an expansion, then principal components of what they do not explain."""

    center: np.ndarray
    names: tuple[str, ...]
    slow: Linear
    spread: np.ndarray
    back: Linear  # from the slow part to the centred input
    scale: np.ndarray
    rest: Linear

    def centred(self) -> Column:
        return F.zip_with("features", numbers(self.center), lambda a, b: a - b)

    def apply(self, samples: DataFrame) -> DataFrame:
        """samples with features: the scaled slow part, then the rest."""
        size = len(self.center)
        rows = samples.withColumn("_c", self.centred())
        rows = rows.withColumn("_both", F.concat(F.col("_c"), expand(F.col("_c"), size, *self.names)))

        def run(x: np.ndarray) -> np.ndarray:
            slow = self.slow(x[:, size:])
            return np.concatenate([slow / self.spread * self.scale, self.rest(x[:, :size] - self.back(slow))], axis=1)

        return map_vectors(rows, run, "_both", "features").drop("_c", "_both")

    def inverse(self, y: np.ndarray) -> np.ndarray:
        """The input that gives y: the slow part's share by regression, and the rest."""
        keep = len(self.spread)
        slow = y[:, :keep] / self.scale * self.spread
        return self.back(slow) + self.rest.inverse(y[:, keep:]) + self.center


def _scales(kind: str | None, back: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """How the slow part is scaled before the rest is put after it."""
    n = back.shape[0]
    if kind == "sensitivity":
        return np.sqrt((back**2).sum(axis=1))
    if kind == "qr":
        return np.abs(np.diag(np.linalg.qr(back.T)[1]))
    if kind == "median":
        return np.full(n, np.sqrt(np.median(residual)) if len(residual) else 1.0)
    if kind is None:
        return np.ones(n)
    raise ValueError(f"no scaling is called {kind}")


def fit_slow_and_rest(samples: DataFrame, mode: str, names: tuple[str, ...] = ("identity", "QT"), delta_threshold: float | int = 1.95, outputs: int | None = None, scaling: str | None = "sensitivity", ridge: float = 1e-9, **graph) -> SlowAndRest:
    """delta_threshold: slow features with a delta up to it (a float), or so many (an int, which raises if there are not as many).

    Three passes: the mean, the moments of the expansion under the mode, and
    those of the slow part with the input; the residual's covariance follows
    from the last.
    """
    size = dimension(samples)
    first = merge(unlabelled(samples, size), size)
    center = first.sx / first.q
    centred = samples.withColumn("_c", F.zip_with("features", numbers(center), lambda a, b: a - b))
    expanded = centred.withColumn("_wide", expand(F.col("_c"), size, *names))
    slow = slow_features(train(expanded.drop("features").withColumnRenamed("_wide", "features"), mode, **graph), ridge=ridge)
    most = min(len(slow.values), outputs or size)
    if isinstance(delta_threshold, int):
        if delta_threshold > most:
            raise ValueError(f"{delta_threshold} slow features of at most {most}")
        keep = delta_threshold
    else:
        keep = min(int((slow.values <= delta_threshold).sum()), most)
    slow = slow.cut(keep)
    with_slow = map_vectors(expanded.select("_c", "_wide"), slow, "_wide", "_slow")
    joint = merge(unlabelled(with_slow.select(F.concat("_slow", "_c").alias("features")), keep + size), keep + size)
    mean, cov, _ = joint.fix()
    spread = np.sqrt(np.diag(cov)[:keep])
    if (spread <= 0).any():
        raise ValueError("a slow feature is constant")
    back = regression(joint, keep) if keep else Linear(np.zeros(0), np.zeros((0, size)), np.zeros(size), mean)
    left = cov[keep:, keep:] - back.weights.T @ cov[:keep, :keep] @ back.weights
    values, vectors = np.linalg.eigh(left)
    k = (outputs or size) - keep
    rest = Linear(np.zeros(size), _signs(vectors[:, ::-1][:, :k]), values[::-1][:k])
    return SlowAndRest(center, names, slow, spread, back, _scales(scaling, back.weights, rest.values), rest)


class SlowBesideComponents:
    """Slow features of an expansion beside principal components of the input itself, learnt from any number of sample sets.

    The slow part is not taken out of the input first, so every set only adds
    to two states of moments; finish gives the model. A slow part has variance
    1 as it is learnt, and scaling None leaves it so; data_dependent gives it
    the median variance of the components that stay, data_dependent2
    variances between the first and the third quarter of theirs, evenly by
    their logarithms. most_slow: slow features at most.
    """

    def __init__(self, names: tuple[str, ...] = ("identity", "QT"), delta_threshold: float | int = 1.95, outputs: int | None = None, scaling: str | None = None, most_slow: int | None = None, ridge: float = 0.0) -> None:
        if scaling not in (None, "data_dependent", "data_dependent2"):
            raise ValueError(f"the scaling {scaling} needs the slow part taken out of the input")
        self.names, self.threshold, self.outputs, self.scaling, self.most, self.ridge = names, delta_threshold, outputs, scaling, most_slow, ridge
        self.slow: Moments | None = None
        self.plain: Moments | None = None

    def train(self, samples: DataFrame, mode, **graph) -> SlowBesideComponents:
        """Adds samples under a mode (or several, as in moments.train)."""
        size = dimension(samples)
        wide = samples.withColumn("features", expand(F.col("features"), size, *self.names))
        slow, plain = train(wide, mode, **graph), merge(unlabelled(samples, size), size)
        self.slow = slow if self.slow is None else self.slow + slow
        self.plain = plain if self.plain is None else self.plain + plain
        return self

    def finish(self) -> SlowAndRest:
        if self.slow is None or self.plain is None:
            raise ValueError("no samples were given")
        size = len(self.plain.sx)
        outputs = self.outputs or size
        slow = slow_features(self.slow, ridge=self.ridge)
        most = min(len(slow.values), outputs, self.most or outputs)
        if isinstance(self.threshold, int):
            if self.threshold > most:
                raise ValueError(f"{self.threshold} slow features of at most {most}")
            keep = self.threshold
        else:
            keep = min(int((slow.values <= self.threshold).sum()), most)
        rest = principal_components(self.plain, outputs - keep)
        center = np.zeros(size)
        nothing = Linear(np.zeros(keep), np.zeros((keep, size)), np.zeros(size), np.zeros(size))
        scale = np.ones(keep)
        n = len(rest.values)
        if self.scaling == "data_dependent" and n:
            scale = np.full(keep, np.sqrt(np.median(rest.values)))
        elif self.scaling == "data_dependent2" and n:
            scale = np.sqrt(np.logspace(np.log10(rest.values[n // 4]), np.log10(rest.values[3 * n // 4]), num=keep))
        return SlowAndRest(center, self.names, slow.cut(keep), np.ones(keep), nothing, scale, rest)


# Bounds, ranges and ranks.


def ranges(samples: DataFrame, column: str = "features") -> DataFrame:
    """(i, low, high) of each component."""
    return samples.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def bounds(samples: DataFrame) -> tuple[list[float], list[float]]:
    rows = sorted(ranges(samples).collect())
    return [r["low"] for r in rows], [r["high"] for r in rows]


def numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cut_off(samples: DataFrame, low: list[float], high: list[float], scale: float = 0.15) -> DataFrame:
    """samples clipped component by component, and correction: the product of 1 - (d / (d + scale))^2, d how far each was out."""
    clipped = clip_between(F.col("features"), numbers(low), numbers(high))
    rows = samples.withColumn("_clipped", clipped)
    out = F.zip_with("features", "_clipped", lambda a, b: F.abs(a - b))
    factor = F.aggregate(out, F.lit(1.0), lambda s, d: s * (1 - F.pow(d / (d + scale), F.lit(2.0))))
    return rows.withColumn("correction", factor).withColumn("features", F.col("_clipped")).drop("_clipped")


def fit_range(samples: DataFrame, low: float = -1.0, high: float = 1.0) -> Column:
    """The features mapped from their training range to low and high, and clipped there; a constant component raises."""
    a, b = bounds(samples)
    if any(x == y for x, y in zip(a, b, strict=True)):
        raise ValueError("a component is constant")
    share = F.zip_with(F.zip_with("features", numbers(a), lambda v, m: v - m), numbers([y - x for x, y in zip(a, b, strict=True)]), lambda v, w: v / w)
    return F.transform(share, lambda v: F.least(F.greatest(low + (high - low) * v, F.lit(low)), F.lit(high)))


def pivots(values: DataFrame, count: int) -> list[float]:
    """Values (column x) at count evenly spaced ranks from the least to the greatest.

    Ranks come from counts of distinct values by range, never from one sorted task.
    """
    n = values.count()
    wanted = sorted({int(np.round(k)) for k in np.linspace(0, n - 1, count)})
    spark = values.sparkSession
    counted = values.groupBy("x").count()
    ranged = settled(counted.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "x").withColumn("part", F.spark_partition_id()))
    totals, start, starts = sorted(ranged.groupBy("part").agg(F.sum("count").alias("n")).collect()), 0, []
    for part, m in totals:
        starts.append((part, start))
        start += m
    from pyspark.sql import Window as W

    placed = ranged.join(F.broadcast(spark.createDataFrame(starts, "part int, before long")), "part")
    last = F.col("before") + F.sum("count").over(W.partitionBy("part").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    placed = placed.select("x", (last - F.col("count")).alias("first"), last.alias("last"))
    ranks = F.broadcast(spark.createDataFrame([(k,) for k in wanted], "rank long"))
    found = {r["rank"]: r["x"] for r in placed.join(ranks, (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))).select("rank", "x").collect()}
    return [found[int(np.round(k))] for k in np.linspace(0, n - 1, count)]


def equalise(x: Column, at: list[float], linear: bool = False) -> Column:
    """x mapped piecewise from the pivots to a half cosine (or evenly) from 0 to 1, and clipped there."""
    t = np.linspace(0, 1, len(at))
    level = t if linear else 0.5 - 0.5 * np.cos(t * np.pi)
    out = F.lit(None).cast("double")
    for k in range(len(at) - 2, -1, -1):
        width = at[k + 1] - at[k]
        line = F.lit(float(level[k])) + (x - at[k]) * float((level[k + 1] - level[k]) / width if width else 0.0)
        out = line if k == len(at) - 2 else F.when(x <= at[k + 1], line).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def standardise(samples: DataFrame) -> DataFrame:
    """samples of mean 0 and variance 1 in each component."""
    size = dimension(samples)
    mean, cov, _ = merge(unlabelled(samples, size), size).fix()
    x = F.zip_with("features", numbers(mean), lambda a, b: a - b)
    return samples.withColumn("features", F.zip_with(x, numbers(np.sqrt(np.maximum(np.diag(cov), 1e-300))), lambda a, b: a / b))


def nonlinear_components(samples: DataFrame, size: int, outputs: int, factor: float = 0.9, name: str = "cos1") -> list[tuple[Linear, Linear]]:
    """Again and again: a principal component, its expansion, the regression of the input on it, which is taken off by a factor."""
    stages = []
    rows = samples.select("features")
    for _ in range(outputs):
        first = principal_components(merge(unlabelled(rows, size), size), 1)
        scored = map_vectors(rows.withColumn("_x", F.col("features")), first, "_x", "_y").drop("_x")
        wide = F.concat("_y", expand(F.transform("_y", lambda v: F.tanh(v)), 1, name))
        joint = scored.select(F.concat(wide, "features").alias("features"))
        inputs = 2  # the component and its expansion
        fitted = regression(merge(unlabelled(joint, inputs + size), inputs + size), inputs)
        both = scored.withColumn("_w", F.concat(wide, "features"))
        rows = map_vectors(both, lambda z, m=fitted, f=factor: z[:, inputs:] - f * m(z[:, :inputs]), "_w", "features").select("features")
        rows = settled(rows)  # the next round reads it twice
        stages.append((first, fitted))
    return stages
