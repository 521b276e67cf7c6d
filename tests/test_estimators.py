import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import estimators as E
from driftline.operators import graphs as G
from driftline.operators import heads as H
from driftline.operators import moments as M
from driftline.plans import network as N

RNG = np.random.default_rng(11)
X = RNG.normal(size=(300, 10)) @ RNG.normal(size=(10, 10))
Y = np.repeat(np.arange(6), 50)
X[:, 0] += Y


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(k, k, v.tolist(), int(c), float(c) * 2 + 1) for k, (v, c) in enumerate(zip(X, Y, strict=True))]
    return spark.createDataFrame(rows, "sample_id long, ord long, features array<double>, class int, label double").repartition(3).cache()


def values(rows, column="features"):
    return np.array([r[column] for r in rows.orderBy("sample_id").collect()])


def test_principal_components(samples):
    m = M.train(samples, "unlabeled")
    model = E.principal_components(m)
    assert np.allclose(model.inverse(model(X)), X)
    assert model.cut(4).weights.shape == (10, 4)
    y = E.principal_components(m, 10, whiten=True)(X)
    assert np.allclose(np.cov(y.T, bias=True), np.eye(10), atol=1e-8)
    some = E.principal_components(m, 0.9)
    assert E.explained_variance(some, m) >= 0.9 > E.explained_variance(some.cut(len(some.values) - 1), m)


@pytest.mark.parametrize("scaling", [None, "sensitivity", "qr", "median"])
def test_slow_and_rest_only_rescales_and_inverts(samples, scaling):
    model = E.fit_slow_and_rest(samples, "classification", ("identity",), 3, scaling=scaling, key=F.col("class"))
    y = values(model.apply(samples))
    assert y.shape == (300, 10)
    assert np.allclose(model.inverse(y), X, atol=1e-6)
    slow = E.slow_features(M.train(samples, "classification", key=F.col("class")), 3)(X)
    assert np.allclose(np.abs(np.corrcoef(y[:, :3].T, slow.T)[:3, 3:]).diagonal(), 1, atol=1e-6)


def test_threshold_limits(samples):
    with pytest.raises(ValueError):
        E.fit_slow_and_rest(samples, "classification", ("identity",), 11, key=F.col("class"))
    nothing = E.fit_slow_and_rest(samples, "classification", ("identity",), 0.0, key=F.col("class"))
    assert len(nothing.spread) == 0
    assert np.allclose(np.abs(values(nothing.apply(samples))), np.abs(E.principal_components(M.train(samples, "unlabeled"))(X)), atol=1e-6)
    everything = E.fit_slow_and_rest(samples, "classification", ("identity",), 4.1, key=F.col("class"))
    assert len(everything.spread) == 10


def test_singular_covariance_raises(samples):
    twice = samples.withColumn("features", F.concat("features", "features"))
    with pytest.raises(ValueError):
        E.slow_features(M.train(twice, "regular"))


def test_regression(samples):
    model = E.fit_regression(samples, F.col("label"))
    a = np.concatenate([X, np.ones((300, 1))], axis=1)
    assert np.allclose(model(X)[:, 0], a @ np.linalg.lstsq(a, Y * 2.0 + 1, rcond=None)[0])


def test_gaussian_classifier(samples):
    p, classes = H.gaussian_classifier(samples, 10)
    q = p(X)
    assert classes == list(range(6)) and np.allclose(q.sum(axis=1), 1)
    logs = []
    for c in classes:
        z = X[Y == c]
        cov = np.cov(z.T, bias=True) + 1e-6 * np.eye(10)
        d = X - z.mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert (q.argmax(axis=1) == np.argmax(logs, axis=0)).all()


def test_label_graph_equals_its_edges(spark, samples):
    rows = G.free_responses(samples, [F.col("label")], F.lit(1.0)).withColumn("v", F.lit(1.0))
    m = G.label_moments(rows, 10, [0.0])
    f = values(rows, "free")
    assert np.allclose(f.T @ f / 300, np.eye(2), atol=1e-9)
    gamma = (f @ f.T) / 300
    d = (X[:, None] - X[None]).reshape(-1, 10)
    assert np.allclose(m.sdd, (d * gamma.reshape(-1)[:, None]).T @ d, rtol=1e-6)


def test_eigenvectors_are_free_responses(spark):
    nodes, edges = G.serial(spark, 20, 5)
    values_, vectors, _ = G.eigenvectors(nodes, edges)
    assert values_[0] == pytest.approx(max(values_)) and np.allclose(vectors.T @ vectors, np.eye(20), atol=1e-9)
    q, r = nodes.agg(F.sum("v")).first()[0], edges.agg(F.sum("w")).first()[0]
    assert G.deltas_of(values_, q, r)[0] == pytest.approx(0)


def test_networks(samples):
    wide = samples.withColumn("features", F.concat(*["features"] * 6, F.slice("features", 1, 4)))
    wide = wide.withColumn("features", F.transform("features", lambda v, i: v + F.sin(i * v)))
    for name in ("void", "two_layers", "shared_two_layers", "three_layers"):
        trained, out = N.train_network(wide, N.NETWORKS[name], "class")
        assert len(trained) == len(N.NETWORKS[name].layers)
        assert len(out.first()["features"]) == (64 if name == "void" else 9)
    assert len(trained[0].models) == 16
    assert N.doubling_sizes(20) == [16, 8, 4, 2]
    assert N.sparse_connections(4, 4, [[True, False], [False, True]], 3)[-1] == [15, 0]
    assert N.preserve_mask(4, 3)[3] == [True, False, False, True]


def test_heads(samples):
    p = samples.select("sample_id", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)).alias("p"))
    row = p.select(H.expected_label(F.col("p"), [1, 2, 4]).alias("e"), H.median_label(F.col("p"), [1, 2, 4]).alias("m"), H.label_to_class(F.lit(3.2), [1.0, 2.0, 4.0], [7, 8, 9]).alias("c")).first()
    assert (round(row["e"], 6), row["m"], row["c"]) == (2.4, 2.0, 9)
    with pytest.raises(ValueError):
        H.label_to_class(F.lit(1.0), [2.0, 1.0], [0, 1])
    rate = samples.agg(H.binary_rate(F.col("label") - 6, (F.col("class") >= 3).cast("int")).alias("r")).first()["r"]
    assert rate == 1.0


def test_nonlinear_components_take_variance_off(samples):
    (first, _), (second, _) = E.nonlinear_components(samples, 10, 2)
    assert second.values[0] < first.values[0]


def test_stream_folds_to_the_same_moments(spark, samples, tmp_path):
    from driftline.streaming.folds import fold, folded

    source = str(tmp_path / "in")
    samples.select("features").repartition(3).write.parquet(source)
    stream = spark.readStream.schema("features array<double>").option("maxFilesPerTrigger", 1).parquet(source)
    fold(stream, lambda rows: M.unlabelled(rows, 10), str(tmp_path / "states"), str(tmp_path / "mark")).awaitTermination()
    assert np.allclose(folded(spark, str(tmp_path / "states"), 10).flat(), M.train(samples, "unlabeled").flat())
