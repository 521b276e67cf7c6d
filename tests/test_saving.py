"""Models that are saved and read again, models learnt from several sets, masks, and connections to further features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import masks
from driftline.operators import estimators as E
from driftline.operators import heads as H
from driftline.operators import moments as M
from driftline.operators import saving
from driftline.plans import network as N

RNG = np.random.default_rng(3)
X = RNG.normal(size=(300, 12)) @ RNG.normal(size=(12, 12)) + 2
CLASS = np.repeat(np.arange(6), 50)
X[:, 0] += CLASS


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(k, k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(X, CLASS, strict=True))]
    return spark.createDataFrame(rows, "sample_id long, ord long, features array<double>, class int").repartition(3).cache()


def values(rows):
    return np.array([r["features"] for r in rows.orderBy("sample_id").collect()])


def test_a_saved_model_gives_the_same(spark, samples, tmp_path):
    slow = E.slow_features(M.train(samples, "classification", key=F.col("class")), 4)
    rest = E.fit_slow_and_rest(samples, "classification", ("identity",), 3, key=F.col("class"))
    saving.save(spark, {"slow": slow, 1: (rest, None, [0.1, True, "x"])}, str(tmp_path / "m"))
    again = saving.load(spark, str(tmp_path / "m"))
    assert again[1][1:] == (None, [0.1, True, "x"])
    assert np.array_equal(again["slow"](X), slow(X))
    assert np.array_equal(values(again[1][0].apply(samples)), values(rest.apply(samples)))
    with pytest.raises(Exception, match="(?i)exist"):
        saving.save(spark, slow, str(tmp_path / "m"))
    with pytest.raises(TypeError):
        saving.as_table(spark, {"f": print})


@pytest.mark.parametrize("shared", [False, True])
def test_a_saved_network_gives_the_same(spark, samples, tmp_path, shared):
    layers = (N.Layer(((0, 1, 2, 3), (4, 5, 6, 7), (8, 9, 10, 11)), 3, ("identity", "u08"), pca=3, shared=shared), N.Layer(None, 4, clip=3.0))
    trained, out = N.train_network(samples, N.Network("two", layers), "class")
    saving.save(spark, trained, str(tmp_path / "n"))
    now = samples
    for layer in saving.load(spark, str(tmp_path / "n")):
        now = N.apply_layer(now, layer)
    assert np.array_equal(values(now), values(out))
    assert N.apply_layer(samples.where("false"), trained[0]).count() == 0


@pytest.mark.parametrize("scaling", [None, "data_dependent", "data_dependent2"])
def test_several_sets_give_what_their_union_gives(samples, scaling):
    learn = lambda: E.SlowBesideComponents(("identity",), 3, scaling=scaling)
    parts = learn()
    for k in range(3):
        parts.train(samples.where(F.col("class") % 3 == k), "classification", key=F.col("class"))
    one, whole = parts.finish(), learn().train(samples, "classification", key=F.col("class")).finish()
    a, b = values(one.apply(samples)), values(whole.apply(samples))
    assert a.shape == (300, 12) and np.allclose(a, b, atol=1e-6)
    variance = np.linalg.eigvalsh(np.cov(X.T, bias=True))[::-1][:9]
    want = {None: np.ones(3), "data_dependent": np.full(3, np.median(variance)), "data_dependent2": np.logspace(np.log10(variance[2]), np.log10(variance[6]), 3)}[scaling]
    assert np.allclose(a.var(axis=0), [*want, *variance])


def test_limits_of_several_sets(samples):
    with pytest.raises(ValueError):
        E.SlowBesideComponents(("identity",), 13).train(samples, "regular").finish()
    with pytest.raises(ValueError):
        E.SlowBesideComponents(("identity",), 4, most_slow=3).train(samples, "regular").finish()
    with pytest.raises(ValueError):
        E.SlowBesideComponents(scaling="qr")
    with pytest.raises(ValueError):
        E.SlowBesideComponents().finish()
    everything = E.SlowBesideComponents(("identity",), 4.1).train(samples, "regular").finish()
    assert len(everything.rest.values) == 0 and len(everything.spread) == 12


def test_list_of_modes_adds_up(samples):
    both = M.train(samples, [("clustered", {"block": 50}), "regular"])
    one, two = M.train(samples, "clustered", block=50), M.train(samples, "regular")
    assert np.allclose(both.flat(), (one + two).flat())
    assert np.allclose(M.train(samples, []).flat(), 0) and np.allclose(M.train(samples, ["ignore_data"]).flat(), 0)


def test_deltas_by_definition(samples):
    d = X[1:] - X[:-1]
    delta, eta = M.typical_deltas(samples, "regular")
    assert np.allclose(delta, (d**2).mean(axis=0)) and np.allclose(eta, 300 / (2 * np.pi) * np.sqrt(delta))
    assert np.allclose(M.deltas(M.train(samples, "regular"), True), delta / X.var(axis=0))
    pairs = [(a, b) for k in range(5) for a in X[k * 50 : k * 50 + 50] for b in X[k * 50 + 50 : k * 50 + 100]]
    delta, eta = M.typical_deltas(samples, "serial", block=50)
    assert np.allclose(delta, np.mean([(a - b) ** 2 for a, b in pairs], axis=0)) and np.allclose(eta, 6 / (2 * np.pi) * np.sqrt(delta))
    assert np.allclose(M.typical_deltas(samples, "mixed", block=50)[0], delta)
    same = [(a, b) for k in range(6) for i, a in enumerate(X[k * 50 : k * 50 + 50]) for j, b in enumerate(X[k * 50 : k * 50 + 50]) if i != j]
    assert np.allclose(M.typical_deltas(samples, "clustered", block=50)[0], np.mean([(a - b) ** 2 for a, b in same], axis=0))


def test_compact_labels():
    table, weights = M.compact_labels(8, 5)
    for c in range(8):
        for j, s in enumerate((4, 2, 1, 7, 3)):  # single bits from the highest, then many bits first and lesser numbers first
            assert table[c, j] == (1 if bin(c & s).count("1") % 2 else -1)
    assert np.allclose(weights, np.array([1, 1, 1, 2 / 3, 1 / 3]) / 4)
    assert abs(table.T @ table - 8 * np.eye(5)).max() == 0
    for wrong in (0, 1, 6):
        with pytest.raises(ValueError):
            M.compact_labels(wrong)
    with pytest.raises(ValueError):
        M.compact_labels(4, 4)


def test_noise_and_masks(spark):
    rows = spark.range(4000).select(F.col("id").alias("sample_id"), F.array(*[F.lit(float(k)) for k in range(5)]).alias("features"))
    x = np.array([r["y"] for r in rows.select(masks.additive_noise(F.col("features"), F.col("sample_id"), 2.0, 7).alias("y")).orderBy("sample_id").collect()])
    again = np.array([r["y"] for r in rows.repartition(5).select("sample_id", masks.additive_noise(F.col("features"), F.col("sample_id"), 2.0, 7).alias("y")).orderBy("sample_id").collect()])
    assert np.array_equal(x, again)
    assert np.allclose(x.mean(axis=0), range(5), atol=0.15) and np.allclose(x.std(axis=0), 2, atol=0.1)
    assert abs(np.corrcoef(x.T) - np.eye(5)).max() < 0.06 and abs(np.mean(((x - x.mean(axis=0)) / x.std(axis=0)) ** 4) - 3) < 0.3
    y = masks.randomized_mask(F.col("features"), F.col("sample_id"), [0, 0.5, 1, 1, 0], [9] * 5, [1] * 5, [False, False, False, True, False])
    got = np.array([r["y"] for r in rows.select(y.alias("y")).collect()])
    assert got.shape == (4000, 4) and (got[:, 0] == 0).all() and (got[:, 3] == 4).all()
    assert np.allclose(got[:, 1:3].mean(axis=0), [5, 9], atol=0.1) and np.allclose(got[:, 1:3].std(axis=0), [0.5, 1], atol=0.05)


def test_further_features(spark, samples):
    more = samples.select("sample_id", F.array(F.col("sample_id") * 1.0, F.lit(5.0)).alias("features"))
    out = values(N.with_more_features(samples, more))
    assert np.array_equal(out, np.concatenate([X, np.arange(300.0)[:, None], np.full((300, 1), 5.0)], axis=1))
    with pytest.raises(Exception, match="no further features for sample"):
        N.with_more_features(samples, more.where("sample_id != 7")).select("features").collect()
    layer = N.with_more_connections(N.Layer(((0, 1), (2, 3)), 2), 12, 2)
    assert layer.connections == ((0, 1, 12, 13), (2, 3, 12, 13)) and N.with_more_connections(N.Layer(None, 2), 12, 2).connections is None


def test_bar_median(spark):
    p = np.random.default_rng(1).dirichlet(np.ones(5), 200)
    labels = np.array([0.0, 1, 3, 4, 8])
    edges = np.array([-0.5, 0.5, 2, 3.5, 6, 10])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(p)], "k long, p array<double>")
    got = [r["y"] for r in rows.select("k", H.bar_median_label(F.col("p"), labels.tolist()).alias("y")).orderBy("k").collect()]
    assert np.allclose(got, [np.interp(0.5, np.concatenate([[0], np.cumsum(v)]), edges) for v in p])


def test_gaussian_classes_in_one_pass(samples):
    probabilities, classes = H.gaussian_classifier(samples, 12)
    assert classes == list(range(6))
    p = probabilities(X)
    logs = []
    for c in classes:
        mine = X[CLASS == c]
        cov = np.cov(mine.T, bias=True) + 1e-6 * np.eye(12)
        d = X - mine.mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    q = np.exp(np.array(logs).T - np.max(logs, axis=0)[:, None])
    assert np.allclose(p, q / q.sum(axis=1, keepdims=True), atol=1e-6)
