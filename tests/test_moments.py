"""Training modes against each other and against numpy, on seeded samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import estimators as E
from driftline.operators import moments as M

RNG = np.random.default_rng(7)
X = RNG.normal(size=(200, 15))
FRESH = RNG.normal(size=(200, 15))
CLASSES = np.repeat(np.arange(5), [29, 41, 50, 35, 45])


def frame(spark, x, classes=None):
    rows = [(k, k, v.tolist(), int(classes[k]) if classes is not None else 0) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "sample_id long, ord long, features array<double>, class int").repartition(4)


@pytest.fixture(scope="module")
def samples(spark):
    return frame(spark, X, CLASSES).cache()


def deltas(m):
    return E.slow_features(m, 5).values


def test_regular_is_plain_slow_feature_analysis(samples):
    model = E.slow_features(M.train(samples, "regular"), 5)
    y = model(X)
    assert np.allclose(y.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(y.T @ y / len(y), np.eye(5), atol=1e-9)
    assert np.allclose((np.diff(y, axis=0) ** 2).mean(axis=0), model.values, atol=1e-9)
    assert (np.diff(model.values) >= 0).all()


def test_clustered_equals_classification_in_any_order(spark, samples):
    order = RNG.permutation(200)
    shuffled = frame(spark, X[order], CLASSES[order])
    a, b = (M.train(s, "classification", key=F.col("class")) for s in (samples, shuffled))
    assert np.allclose(a.flat(), b.flat(), atol=1e-8)


def test_linear_graph_equals_regular(spark, samples):
    """Half loops at the ends make the chain consistent; they have no differences."""
    nodes = samples.select("sample_id", F.lit(1.0).alias("v"))
    edges = spark.range(199).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    m = M.train(samples, "graph", nodes=nodes, edges=edges)
    assert np.allclose(m.flat(), M.train(samples, "regular").flat(), atol=1e-8)


def test_random_graph_gives_zero_mean_unit_variance_and_lower_training_deltas(spark, samples):
    pairs = {(int(a), int(b)): float(w) for a, b, w in zip(RNG.integers(0, 200, 1500), RNG.integers(0, 200, 1500), RNG.uniform(0, 2, 1500), strict=True)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "src long, dst long, w double")
    nodes = samples.select("sample_id", F.lit(1.0).alias("v"))
    model = E.slow_features(M.train(samples, "graph", nodes=nodes, edges=edges), 5)
    y, z = model(X), model(FRESH)
    assert np.allclose(y.mean(axis=0), 0, atol=1e-9) and np.allclose(y.var(axis=0), 1, atol=1e-9)
    delta = lambda v: sum(w * (v[b] - v[a]) ** 2 for (a, b), w in pairs.items()) / sum(pairs.values())
    assert np.allclose(delta(y), model.values, atol=1e-9)
    assert delta(y).sum() < delta(z / z.std(axis=0)).sum()


@pytest.mark.parametrize("width", [3, 32])
def test_windows_agree(samples, width):
    assert np.allclose(deltas(M.train(samples, f"window{width}")), deltas(M.train(samples, f"fwindow{width}")))
    d = np.zeros((15, 15))
    mirrored = np.concatenate([X[:width][::-1], X, X[-width:][::-1]])
    for o in [*range(-width, 0), *range(1, width + 1)]:
        e = mirrored[width + o : width + o + 200] - X
        d += e.T @ e
    m = M.train(samples, f"smirror_window{width}")
    assert np.allclose(m.sdd, d) and m.r == 2 * width * 200


def test_buckets_of_neighbours_do_not_change_results(samples, monkeypatch):
    want = M.train(samples, "window3"), M.train(samples, "mirror_window3"), M.train(samples, "regular")
    monkeypatch.setattr(M, "BUCKET", 16)
    for mode, w in zip(("window3", "mirror_window3", "regular"), want, strict=True):
        assert np.allclose(M.train(samples, mode).flat(), w.flat(), atol=1e-8)


def test_unlabelled_samples(spark, samples):
    labelled = M.train(samples, "classification", key=F.col("class"))
    m = M.with_unlabelled(labelled, frame(spark, FRESH))
    assert m.q == pytest.approx(200 * 1.2 - 0.025 * 200)
    pairs = (X[:, None, :] - FRESH[None, :, :]).reshape(-1, 15)
    v2 = 200 * 0.2 / 200
    inner = 2 * (FRESH.T @ FRESH - np.outer(FRESH.sum(0), FRESH.sum(0)) / 200)
    want = labelled.sdd * (200 / labelled.r * 0.8) + v2 / 200 * 2 * pairs.T @ pairs - 0.025 * inner
    assert np.allclose(m.sdd, want)


def test_a_second_serial_graph_counts_for_nothing(samples):
    a, b = M.merge(M.dual_serial(samples, 15, 10, 20, 200), 15), M.train(samples, "serial", block=10)
    assert np.allclose(a.flat(), b.flat())


def test_errors(samples):
    with pytest.raises(ValueError):
        M.train(samples, "no such mode")
    with pytest.raises(ValueError):
        M.train(samples, "serial", block=7)
    with pytest.raises(ValueError):
        M.train(samples, "window100")
    with pytest.raises(ValueError):
        M.compact_labels(6)
    with pytest.raises(ValueError):
        M.dimension(samples.where("false"))
    assert M.train(samples, "ignore_data").q == 0
