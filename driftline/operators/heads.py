"""Classifiers and regressions on extracted features, and their measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions.vectors import squared_distance
from driftline.operators.estimators import map_vectors
from driftline.operators.moments import Moments, add_up, group_sums, lists, matrix
from driftline.session import ship

#: Rows of a reference set that may be sent to every task.
BROADCAST_ROWS = 50_000
#: Class means that may be sent to every task; rows of queries that a task holds.
BROADCAST_CLASSES, QUERY_ROWS = 1_000, 20_000


def class_means(samples: DataFrame, key: str = "class") -> DataFrame:
    """(class, n, mean) of each class."""
    sums = group_sums(samples, F.col(key))
    return sums.select(F.col("key").alias("class"), "n", F.transform("total", lambda v: v / F.col("n")).alias("mean"))


def nearest_mean(samples: DataFrame, means: DataFrame) -> DataFrame:
    """samples with predicted: the class of the nearest mean, the lesser of equals. means: (class, mean), one row a class.

    Up to BROADCAST_CLASSES means go to every task; more are searched by
    nearest_neighbours, for which samples need a sample_id.
    """
    table = means.select(F.col("class").alias("_class"), "mean")
    if table.count() > BROADCAST_CLASSES:
        near = nearest_neighbours(samples.select(F.col("sample_id").alias("query_id"), "features"), table.select(F.col("_class").cast("long").alias("reference_id"), F.col("mean").alias("features")), 1)
        return samples.join(near.select(F.col("query_id").alias("sample_id"), F.col("reference_id").alias("predicted")), "sample_id")
    listed = table.agg(F.sort_array(F.collect_list(F.struct("_class", "mean"))).alias("_means"))
    rows = samples.crossJoin(F.broadcast(listed))
    best = F.array_min(F.transform("_means", lambda m: F.struct(squared_distance(F.col("features"), m["mean"]).alias("d"), m["_class"].alias("c"))))
    return rows.withColumn("predicted", best["c"]).drop("_means")


def class_states(samples: DataFrame, size: int, key: str = "class") -> dict[int, Moments]:
    """The moments of each class, an integer, in rising order. One pass."""
    ship(samples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Moments] = {}
        for batch in batches:
            if batch.num_rows:
                of, x = batch.column("k").to_numpy(), matrix(batch)
                for c in np.unique(of).tolist():
                    states.setdefault(c, Moments.zero(size)).nodes(x[of == c])
        yield pa.RecordBatch.from_arrays([pa.array(list(states), pa.int32()), lists([s.flat() for s in states.values()])], ["k", "state"])

    rows = samples.where(F.col(key).isNotNull()).select(F.col(key).cast("int").alias("k"), "features")
    found = add_up(rows.mapInArrow(run, "k int, state array<double>"), "k").toArrow()
    return {k: Moments.of(v.values.to_numpy(zero_copy_only=False), size) for k, v in sorted(zip(found.column("k").to_pylist(), found.column("state"), strict=True), key=lambda x: x[0])}


def gaussian_classifier(samples: DataFrame, size: int, key: str = "class", ridge: float = 1e-6):
    """A function of a feature matrix that gives the probabilities of all classes (in rising order), and the classes, which are integers. One pass."""
    states = class_states(samples, size, key)
    return gaussian_of(states, ridge), list(states)


def gaussian_of(states: dict[int, Moments], ridge: float = 1e-6):
    total = sum(s.q for s in states.values())
    parts = []
    for s in states.values():
        mean, cov, _ = s.fix()
        root = np.linalg.cholesky(cov + ridge * np.eye(len(mean)))
        parts.append((mean, np.linalg.inv(root), -2 * 0.5 * float(np.log(np.diag(root)).sum()) + float(np.log(s.q / total))))

    def probabilities(x: np.ndarray) -> np.ndarray:
        logs = np.stack([c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, c in parts], axis=1)
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    return probabilities


def with_probabilities(samples: DataFrame, probabilities) -> DataFrame:
    return map_vectors(samples, probabilities, "features", "p")


def soft_rate(rows: DataFrame, place: Column) -> DataFrame:
    """(soft_rate): the mean probability of the true class; place: its place in p from 0."""
    return rows.agg(F.avg(F.get("p", place)).alias("soft_rate"))


def expected_label(p: Column, labels: list[float]) -> Column:
    """The label of least squared error: the mean of the labels by probability."""
    return F.aggregate(F.zip_with(p, F.array(*[F.lit(float(x)) for x in labels]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def median_label(p: Column, labels: list[float]) -> Column:
    """The label of least absolute error: the first at which the summed probability is over a half."""
    pairs = F.zip_with(p, F.array(*[F.lit(float(x)) for x in labels]), lambda a, b: F.struct(a.alias("p"), b.alias("l")))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("l"))
    step = lambda s, v: F.struct((s["s"] + v["p"]).alias("s"), F.coalesce(s["l"], F.when(s["s"] + v["p"] > 0.5, v["l"])).alias("l"))
    return F.coalesce(F.aggregate(pairs, start, step)["l"], F.lit(float(labels[-1])))


def bar_median_label(p: Column, labels: list[float]) -> Column:
    """The label of least absolute error if a class's probability lies evenly over a bar between the middles to its neighbours' labels.

    The median within the bar of the first class at which the summed
    probability is over a half; the outer bars are as wide on both sides.
    Two classes at least.
    """
    if len(labels) < 2:
        raise ValueError("bars need two classes at least")
    middles = [(a + b) / 2 for a, b in zip(labels, labels[1:], strict=False)]
    low = [labels[0] - (middles[0] - labels[0]), *middles]
    high = [*middles, labels[-1] + (labels[-1] - middles[-1])]
    numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])
    cells = F.zip_with(F.zip_with(p, numbers(low), lambda a, b: F.struct(a.alias("p"), b.alias("low"))), numbers(high), lambda c, h: F.struct(c["p"].alias("p"), c["low"].alias("low"), h.alias("high")))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("l"))
    inside = lambda s, v: v["low"] + (0.5 - s["s"]) * (v["high"] - v["low"]) / v["p"]
    step = lambda s, v: F.struct((s["s"] + v["p"]).alias("s"), F.coalesce(s["l"], F.when(s["s"] + v["p"] > 0.5, inside(s, v))).alias("l"))
    return F.coalesce(F.aggregate(cells, start, step)["l"], F.lit(float(labels[-1])))


def nearest_neighbours(queries: DataFrame, reference: DataFrame, k: int, skip_same: bool = False) -> DataFrame:
    """(query_id, reference_id, rank, distance2): the k nearest of reference (reference_id, features) for each of queries (query_id, features).

    Blocks of queries meet blocks of the reference in numpy; k rows a pair of
    blocks are left, of which the k best stay. Ties go to the lesser id.
    skip_same leaves out distances of 0.
    """
    blocks = max(1, -(-reference.count() // BROADCAST_ROWS))
    parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) // blocks, -(-queries.count() // QUERY_ROWS), 1)
    q = queries.select("query_id", "features", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    q = q.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    r = reference.select("reference_id", F.col("features").alias("other"), F.pmod(F.xxhash64("reference_id"), F.lit(blocks)).alias("block"))
    r = r.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = matrix(left) if left.num_rows else None, matrix(right, "other") if right.num_rows else None
        ids, others, dist = [], [], []
        if a is not None and b is not None:
            names = right.column("reference_id").to_numpy()
            order = np.argsort(names, kind="stable")
            b, names = b[order], names[order]
            for start in range(0, len(a), 256):
                d = ((a[start : start + 256, None, :] - b[None, :, :]) ** 2).sum(axis=2) if b.size * 256 < 5e7 else (a[start : start + 256] ** 2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a[start : start + 256] @ b.T
                d = np.where(d <= 0, np.inf, d) if skip_same else d
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                keep = np.isfinite(np.take_along_axis(d, best, axis=1))
                ids.append(np.repeat(left.column("query_id").to_numpy()[start : start + 256], keep.sum(axis=1)))
                others.append(names[best[keep]])
                dist.append(np.take_along_axis(d, best, axis=1)[keep])
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        return pa.table({"query_id": pa.array(join(ids, np.int64)), "reference_id": pa.array(join(others, np.int64)), "distance2": pa.array(join(dist, float))})

    near = q.groupBy("part", "block").cogroup(r.groupBy("part", "block")).applyInArrow(run, "query_id long, reference_id long, distance2 double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance2", "reference_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbour_votes(near: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, predicted, average): the commonest label of the neighbours, the lesser of equals, and their mean. labels: (reference_id, label)."""
    rows = near.join(labels, "reference_id")
    votes = rows.groupBy("query_id", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("query_id").agg(F.min(F.struct(-F.col("n"), "label"))["label"].alias("predicted"))
    return best.join(rows.groupBy("query_id").agg(F.avg("label").alias("average")), "query_id")


# Labels and classes.


def class_labels(samples: DataFrame, key: str = "class", label: str = "label") -> DataFrame:
    """(class, label): the mean label of each class."""
    return samples.groupBy(F.col(key).alias("class")).agg(F.avg(label).alias("label"))


def label_to_class(label: Column, labels: list[float], classes: list[int]) -> Column:
    """The class whose label is nearest: by the middles between labels, which must rise."""
    if any(a >= b for a, b in zip(labels, labels[1:], strict=False)):
        raise ValueError("labels of classes must rise")
    middles = [(a + b) / 2 for a, b in zip(labels, labels[1:], strict=False)]
    place = F.size(F.filter(F.array(*[F.lit(float(m)) for m in middles]).cast("array<double>"), lambda m: m < label))
    return F.element_at(F.array(*[F.lit(int(c)) for c in classes]), place + 1)


def rounded(label: Column, years: bool = False) -> Column:
    return label.cast("long") if years else F.rint(label).cast("long")


# Measures.


def mean_absolute_error(truth: Column, guess: Column) -> Column:
    return F.avg(F.abs(truth - guess))


def mean_squared_error(truth: Column, guess: Column) -> Column:
    return F.avg((truth - guess) * (truth - guess))


def root_mean_squared_error(truth: Column, guess: Column) -> Column:
    return F.sqrt(mean_squared_error(truth, guess))


def classification_rate(truth: Column, guess: Column) -> Column:
    return F.avg(F.when(truth.cast("long") == guess.cast("long"), 1.0).otherwise(0.0))


def chance_levels(rows: DataFrame, truth: str) -> DataFrame:
    """(rmse, mae): what a constant guess reaches, the mean and the value of the middle rank (n // 2)."""
    n = rows.count()
    median = rows.groupBy(F.col(truth).alias("t")).count()
    before = F.coalesce(F.sum("count").over(W.orderBy("t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # distinct labels only
    middle = median.withColumn("before", before).where((F.col("before") <= n // 2) & (F.col("before") + F.col("count") > n // 2)).first()["t"]
    return rows.agg(F.stddev_pop(truth).alias("rmse"), F.avg(F.abs(F.col(truth) - middle)).alias("mae"))


def cumulative_scores(rows: DataFrame, truth: Column, guess: Column, most: int = 30, whole: bool = True) -> DataFrame:
    """(error, score): the share of rows with an absolute error up to each of 0 to most."""
    e = F.abs(F.rint(truth) - F.rint(guess)) if whole else F.abs(truth - guess)
    shares = rows.agg(*[F.avg(F.when(e <= j, 1.0).otherwise(0.0)).alias(str(j)) for j in range(most + 1)])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(j).alias("error"), F.col(str(j)).alias("score")) for j in range(most + 1)])).alias("x")).select("x.error", "x.score")


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def error_table(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, n, mae, mean_guess, bias) for each true label."""
    e = F.col(guess) - F.col(truth)
    return rows.groupBy(F.col(truth).alias("truth")).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(guess).alias("mean_guess"), F.avg(e).alias("bias"))


def binary_rate(score: Column, truth: Column, threshold: float = -0.05) -> Column:
    return F.avg(F.when((score >= threshold) == (truth == 1), 1.0).otherwise(0.0))
