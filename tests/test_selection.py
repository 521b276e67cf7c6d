import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import estimators as E
from driftline.operators import inversion as I
from driftline.operators import moments as M
from driftline.operators import selection as S
from driftline.plans import network as N

RNG = np.random.default_rng(5)
X = RNG.normal(size=(240, 6))
C = np.repeat(np.arange(4), 60)
X[:, 0] += C


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(k, k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(X, C, strict=True))]
    return spark.createDataFrame(rows, "sample_id long, ord long, features array<double>, class int").repartition(3).cache()


def values(rows, column="features"):
    return np.array([r[column] for r in rows.orderBy("sample_id").collect()])


def share(z, target):
    z = z - z.mean(axis=0)
    t = target - target.mean(axis=0)
    return 1 - ((t - z @ np.linalg.lstsq(z, t, rcond=None)[0]) ** 2).sum() / (t**2).sum()


def test_ranks_equal_forward_selection_by_regression(samples):
    target = X[:, [0]] * X[:, [1]] + 0.5 * X[:, [2]] ** 2 + 0.1 * X[:, [3]] * X[:, [4]]
    ranked = S.rank_expansion(samples, ("QT",), 4, F.array(F.expr("features[0] * features[1] + 0.5 * features[2] * features[2] + 0.1 * features[3] * features[4]")))
    wide = I.numeric_expansion(["QT"])(X)
    chosen = []
    for r in ranked:
        scores = [-1 if k in chosen else share(wide[:, [*chosen, k]], target) for k in range(wide.shape[1])]
        chosen.append(int(np.argmax(scores)))
        assert r.place == chosen[-1] and r.explained == pytest.approx(max(scores), abs=1e-9)
    assert len(ranked) == 3 and ranked[-1].explained == pytest.approx(1)  # nothing is left to explain
    assert np.allclose(values(S.with_ranked(samples, ("QT",), ranked)), wide[:, chosen])


def test_search_puts_the_right_expansion_first(samples):
    found = S.search_expansions(samples, {"linear": ("identity",), "all": ("identity", "QT")}, F.array(F.expr("features[0] * features[1]")))
    assert [f[0] for f in found] == ["all", "linear"] and found[0][1] == 27
    assert found[0][2] == pytest.approx(1, abs=1e-6) and found[1][2] == pytest.approx(share(X, X[:, [0]] * X[:, [1]]), abs=1e-6)


def test_adapted_sigmoids_are_no_faster_than_linear_features(samples):
    linear = E.slow_features(M.train(samples, "classification", key=F.col("class")), 2)
    model = S.adapt_sigmoids(samples, "classification", 14, 2, key=F.col("class"))
    assert model.slow.values.sum() <= linear.values.sum() + 1e-4
    assert np.allclose(values(E.map_vectors(samples, model)), model(X))
    with pytest.raises(ValueError):
        S.adapt_sigmoids(samples, "classification", 3, 2, key=F.col("class"))


def test_unlabelled_in_classes_equal_their_edges(spark, samples):
    some, more = samples.where("ord % 2 = 0"), samples.where("ord % 2 = 1")
    old = M.train(some, "classification", key=F.col("class"))
    got = M.with_unlabelled_in_classes(old, more, 4, 0.25)
    a, b, u = X[::2], X[1::2], 0.25 / 4
    r1, r2 = 30 - 1 + u * 120, 30 + u * 119
    pairs = lambda p, q: (p[:, None] - q[None]).reshape(-1, 6)
    ab, bb = pairs(a, b), pairs(b, b)
    sdd = old.sdd * (29 / r1) + u * (1 / r1 + 1 / r2) * ab.T @ ab + u * u / r2 * 119 * 4 / 120 * bb.T @ bb
    assert np.allclose(got.sdd, sdd) and got.q == pytest.approx(120 + 0.25 * 120)


def test_network_states_equal_each_group_by_itself(samples):
    layer = N.Layer(((0, 1), (2, 3), (4, 5)), 2)
    for group in (F.col("class"), F.when(F.col("class") > 0, F.col("class"))):
        states = N._states(N.fields(samples, layer), group, 2)
        assert sorted(states) == [0, 1, 2]
        for k, s in states.items():
            x = X[:, 2 * k : 2 * k + 2]
            d = sum(2 * (z.T @ z - np.outer(z.sum(0), z.sum(0)) / len(z)) for z in (x[c == C] for c in range(4)))
            assert s.q == s.r == 240 and np.allclose(s.sdd, d) and np.allclose(s.sxx, x.T @ x)


def test_network_inverse(samples):
    square = N.Network("t", (N.Layer(((0, 1, 2), (2, 3, 4)), 3, ("identity", "u08"), clip=None), N.Layer(None, 4, clip=None)))
    trained, out = N.train_network(samples, square, "class")
    y = values(out)
    both = samples.join(out.select("sample_id", F.col("features").alias("y")), "sample_id")
    same = values(I.network_inverse(trained, both, F.col("y")), "inverted")
    assert np.allclose(same, X, atol=1e-6)  # nothing is asked for; component 5 is seen by none
    moved = values(I.network_inverse(trained, both, F.transform("y", lambda v: v * 0.8), closeness=0.01), "inverted")
    forward = I.layer_forward(trained[1], I.layer_forward(trained[0], moved))
    assert np.linalg.norm(forward - 0.8 * y) < np.linalg.norm(y - 0.8 * y)
    assert np.allclose(moved[:, 5], X[:, 5])
    with pytest.raises(ValueError):
        I.numeric_expansion(["cos1"])


def test_least_squares_inverse_reaches_its_optimum():
    z = I.least_squares_inverse(lambda v: v**2, np.array([[1.0], [2.0]]), np.array([[4.0], [4.0]]), closeness=1e-9)
    assert np.allclose(z, [[2.0], [2.0]], atol=1e-4)


def test_reconstruction_from_neighbours(spark, samples):
    from driftline.operators import heads as H

    q = samples.select(F.col("sample_id").alias("query_id"), "features")
    ref = samples.select(F.col("sample_id").alias("reference_id"), "features", F.col("features").alias("input"))
    near = H.nearest_neighbours(q, ref.select("reference_id", "features"), 5, skip_same=True)
    d = ((X[:, None] - X[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1)[:, :5]
    mean = {r["query_id"]: r["made"] for r in I.from_neighbours(near, q, ref).collect()}
    assert np.allclose([mean[k] for k in range(240)], X[order].mean(axis=1))
    w = I.local_weights(X, X[order])
    assert np.allclose(w.sum(axis=1), 1)
    fits = I.from_neighbours(near, q, ref, "linear")
    made = {r["query_id"]: r["made"] for r in fits.collect()}
    assert np.allclose([made[k] for k in range(240)], (w[:, :, None] * X[order]).sum(axis=1))
    got = I.explained_by(fits.join(q, "query_id"), "features", "made").first()
    want = 1 - ((X - (w[:, :, None] * X[order]).sum(axis=1)) ** 2).sum() / ((X - X.mean(0)) ** 2).sum()
    assert got["n"] == 240 and got["explained"] == pytest.approx(want)
    with pytest.raises(ValueError):
        I.from_neighbours(near, q, ref, "cubic")
