"""Cut-offs, linear views, probes, balls, blocks of graphs, parts of graphs and slots, each against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import cutoff as C
from driftline.operators import estimators as E
from driftline.operators import graphblocks as B
from driftline.operators import graphs as G
from driftline.operators import heads as H
from driftline.operators import linear_view as L
from driftline.operators import moments as M
from driftline.operators import neighbours as NB
from driftline.plans import slots as S

RNG = np.random.default_rng(8)
X = RNG.normal(size=(90, 5)) @ RNG.normal(size=(5, 5)) + 1


def table(spark, x=X, classes=3):
    return spark.createDataFrame([(k, k, k % classes, [float(v) for v in r]) for k, r in enumerate(x)], "sample_id long, ord long, class int, features array<double>").repartition(3)


def features(rows, column="features"):
    return np.array([r[column] for r in sorted(rows.collect(), key=lambda r: r["sample_id"])])


def plain_cut(model, x):
    factor, normal = np.ones(len(x)), np.zeros(len(x))
    for turn, low, high in zip(model.rotations, model.low, model.high, strict=True):
        y = x @ turn
        cut = np.clip(y, low, high)
        d = np.abs(cut - y) / (high - low)
        factor *= (1 - (d / (d + 0.15)) ** 2).prod(axis=1)
        s = 4 * model.spread
        normal += (-0.5 * ((x - model.mean) / s) ** 2 - np.log(s * np.sqrt(2 * np.pi))).sum(axis=1)
        x = cut @ turn.T
    return x, factor, normal


def test_cut_off(spark):
    model = C.fit_cut_off(table(spark), 3, seed=4)
    for turn, low, high in zip(model.rotations, model.low, model.high, strict=True):
        assert np.allclose(turn @ turn.T, np.eye(5)) and np.allclose(low, (X @ turn).min(axis=0)) and np.allclose(high, (X @ turn).max(axis=0))
    assert (model.rotations[0] == np.eye(5)).all() and np.allclose(model.mean, X.mean(axis=0)) and np.allclose(model.spread, X.std(axis=0))
    far = X * 1.5 + 0.3
    got = C.apply_cut_off(table(spark, far), model)
    y, factor, normal = plain_cut(model, far)
    assert np.allclose(features(got), y) and np.allclose(features(got, "correction"), factor) and np.allclose(features(got, "log_normal"), normal)
    assert np.allclose(features(C.apply_cut_off(table(spark), model), "correction"), 1)
    twice = C.apply_cut_off(got.withColumn("features", F.transform("features", lambda v: v * 2)), model, only_measure=True)
    y2, f2, n2 = plain_cut(model, y * 2)
    assert np.allclose(features(twice), y * 2) and np.allclose(features(twice, "correction"), factor * f2) and np.allclose(features(twice, "log_normal"), normal + n2)
    worst = C.most_unusual(got, 5).collect()
    assert [r["sample_id"] for r in worst] == sorted(range(len(far)), key=lambda k: (factor[k], k))[:5]
    both = got.select(C.combined([F.col("correction"), F.lit(0.5), F.lit(None).cast("double")]).alias("a"), C.combined([F.col("correction"), F.lit(0.5)], average=False).alias("b"), C.combined([F.lit(None).cast("double")]).alias("c"), "correction").collect()
    assert all(abs(r["a"] - (r["correction"] + 0.5) / 2) < 1e-12 and abs(r["b"] - r["correction"] / 2) < 1e-12 and r["c"] is None for r in both)


def test_a_constant_component_is_cut(spark):
    x = np.array([[1.0, 2.0], [1.0, 3.0]])
    model = C.fit_cut_off(table(spark, x))
    got = C.apply_cut_off(table(spark, np.array([[1.0, 2.5], [1.5, 2.5]])), model)
    assert features(got, "correction").tolist() == [1.0, 0.0] and features(got).tolist() == [[1.0, 2.5], [1.0, 2.5]]


def test_linear_view_is_exact_for_a_linear_network(spark):
    w = np.random.default_rng(1).normal(size=(5, 5))
    rows = E.map_vectors(table(spark), lambda x: x @ w + 2, "features", "outputs")
    view = L.linear_view(rows)
    assert view.explained == pytest.approx(1) and np.allclose(view.sensitivity, (np.linalg.inv(w) ** 2).sum(axis=1))
    near = L.approximate(rows, view)
    assert np.allclose(features(near, "approximated"), X) and np.allclose(features(near.withColumn("d", L.residual(near)), "d"), 0, atol=1e-8)
    assert np.allclose(view.influence, (w**2).sum(axis=1) * X.var(axis=0))
    part = L.linear_view(E.map_vectors(table(spark), lambda x: x[:, :2] ** 3, "features", "outputs"))
    a = np.concatenate([np.ones((len(X), 1)), X[:, :2] ** 3], axis=1)
    fitted = np.linalg.lstsq(a, X, rcond=None)[0]
    assert part.explained == pytest.approx(1 - ((X - a @ fitted) ** 2).sum() / ((X - X.mean(axis=0)) ** 2).sum())
    assert np.allclose(part.sensitivity, (fitted[1:] ** 2).sum(axis=1))


def test_probes_by_their_definition(spark):
    rows = table(spark)
    y = np.sin(X[:, 0]) + X[:, 1] ** 2
    target = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "sample_id long, y double")
    got = {r["basis"]: r for r in L.probe(rows.join(target, "sample_id"), F.col("y"), [3, 12], ridge=0.0).collect()}
    w, o = L.probe_bases(5, [3, 12])
    for n in (0, 3, 12):
        a = np.concatenate([np.ones((90, 1)), X, np.tanh(X @ w + o)[:, :n]], axis=1)
        left = ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).mean()
        assert got[n]["mse"] == pytest.approx(left, rel=1e-6) and got[n]["explained"] == pytest.approx(1 - left / y.var(), rel=1e-6)
    rates = {r["basis"]: r["rate"] for r in L.probe_classes(rows.withColumn("class", (F.get("features", 0) > 1).cast("int")), [2, 8]).collect()}
    c = (X[:, 0] > 1).astype(int)
    for n in (2, 8):
        z = np.tanh(X @ w[:, :n] + o[:n]) if n <= 12 else None
        w8, o8 = L.probe_bases(5, [2, 8])
        z = np.tanh(X @ w8 + o8)[:, :n]
        logs = [np.log((c == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) for k in (0, 1) for s in [np.cov(z[c == k].T, bias=True) + 1e-6 * np.eye(n)] for d in [z - z[c == k].mean(axis=0)]]
        assert rates[n] == pytest.approx(((logs[1] > logs[0]) == c).mean())


@pytest.mark.parametrize("skip_same", [False, True])
def test_balls_find_the_nearest(spark, monkeypatch, skip_same):
    """Clustered rows with ties and repeated ones, balls of several blocks: all distances by brute force, and few pairs of balls met."""
    monkeypatch.setattr(NB, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 4)) * 50
    ref = np.round(centers[rng.integers(0, 12, 400)] + rng.normal(size=(400, 4)), 1)
    ref[:30] = ref[0]
    ask = np.concatenate([ref[:60], np.round(centers[rng.integers(0, 12, 40)] + rng.normal(size=(40, 4)), 1), [[1e4] * 4]])
    r = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(ref)], "reference_id long, features array<double>")
    q = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(ask)], "query_id long, features array<double>")
    index = NB.BallIndex(r, 24)
    got = {(x["query_id"], x["rank"]): (x["reference_id"], x["distance2"]) for x in index.search(q, 3, skip_same).collect()}
    assert len(got) == 3 * len(ask)
    for k, v in enumerate(ask):
        d = ((v - ref) ** 2).sum(axis=1)
        want = sorted((x, i) for i, x in enumerate(d) if not skip_same or x > 0)[:3]
        for n, (x, i) in enumerate(want):
            assert got[k, n + 1] == (i, x)
    assert index.met < 0.5 * index.all_pairs
    assert NB.BallIndex(r.where("false")).search(q, 2).count() == 0


def test_blocks_and_edges_of_a_graph(spark):
    """Any graph as edges, as blocks and as a whole matrix gives the same moments."""
    rng = np.random.default_rng(2)
    pairs = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, 90, 500), rng.integers(0, 90, 500), rng.normal(1, 1, 500), strict=True)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "src long, dst long, w double")
    nodes = G.uniform_nodes(spark, 90)
    blocks = B.to_blocks(edges, 16)
    assert {(r["src"], r["dst"]): r["w"] for r in B.to_edges(blocks, 16).collect()} == pytest.approx(pairs)
    got = B.block_moments(table(spark), nodes, blocks, 16, 5)
    want = M.train(table(spark), "graph", nodes=nodes, edges=edges)
    w = np.zeros((90, 90))
    for (a, b), v in pairs.items():
        w[a, b] = v
    whole = X.T @ (np.diag(w.sum(axis=0)) + np.diag(w.sum(axis=1)) - w - w.T) @ X
    assert np.allclose(got.sdd, whole) and np.allclose(want.sdd, whole) and got.r == pytest.approx(w.sum()) and np.allclose(got.sxx, want.sxx) and got.q == 90


def test_parts_of_a_training_graph(spark):
    rows = B.split_groups(table(spark), F.col("class"), 2, seed=1)
    held = rows.collect()
    sizes = {(p, c): sum(r["part"] == p and r["class"] == c for r in held) for p in (0, 1) for c in range(3)}
    assert set(sizes.values()) == {15} and {r["sample_id"] for r in held} == set(range(90))
    assert all(sorted(r["place"] for r in held if (r["part"], r["class"]) == k) == list(range(15)) for k in sizes)
    for part in (0, 1):
        nodes, edges = B.part_graph(rows, part, F.col("class"))
        assert nodes.count() == 45 and G.consistency(nodes, edges).where("not consistent").count() == 0
    assert B.split_groups(table(spark), F.col("class"), 2, seed=2).where("part = 0").collect() != rows.where("part = 0").collect()
    regular = B.split_regular(table(spark), 3).groupBy("part").count().collect()
    assert len(regular) == 3 and sum(r["count"] for r in regular) == 90


def clustered(x, classes):
    """Moments of all pairs within classes."""
    s = M.Moments.zero(x.shape[1])
    s.nodes(x)
    s.r, s.sdd = float(len(x)), 2 * x.T @ x
    for c in np.unique(classes):
        t = x[classes == c].sum(axis=0)
        s.sdd = s.sdd - 2 * np.outer(t, t) / (classes == c).sum()
    return s


def test_a_layer_equals_its_nodes_by_hand(spark):
    """Principal components, order, expansion, reduction and the information-preserving node of two fields."""
    layer = S.SlotLayer(((0, 1, 2), (2, 3, 4)), pca="PrincipalComponents", order="Ordering", expansions=("identity", "QT"), reduction="PrincipalComponents", last="SlowFeatures", parameters={"pca": {"outputs": 2}, "reduction": {"outputs": 4}, "outputs": 3, "order_by": "variance"})
    trained = S.train_slots(table(spark, classes=5), layer, "class")
    got = features(S.apply_slots(table(spark), trained))
    classes = np.arange(90) % 5
    want = []
    for c in layer.connections:
        x = X[:, list(c)]
        x = E.principal_components(clustered(x, classes), 2)(x)
        x = S.Ordering.fit(clustered(x, classes), "variance")(x)
        x = np.concatenate([x, np.stack([x[:, i] * x[:, j] for i in range(2) for j in range(i, 2)], axis=1)], axis=1)
        x = E.principal_components(clustered(x, classes), 4)(x)
        want.append(E.slow_features(clustered(x, classes), 3)(x))
    assert np.allclose(got, np.concatenate(want, axis=1), atol=1e-6)
    assert [s for s, _ in trained.steps] == ["pca", "order", "expansion", "reduction", "last"]


def test_information_preserving_slot(spark):
    layer = S.SlotLayer(expansions=("identity", "QT"), last="InformationPreserving", parameters={"delta_threshold": 2, "outputs": 5, "ridge": 1e-9})
    trained = S.train_slots(table(spark), layer, "class")
    y = features(S.apply_slots(table(spark), trained))
    assert y.shape == (90, 5)
    slow, rest = y[:, :2], y[:, 2:]
    assert np.allclose(np.cov(slow.T, rest.T, bias=True)[:2, 2:], 0, atol=1e-8)
    by_hand = E.fit_slow_and_rest(table(spark), "classification", ("identity", "QT"), 2, 5, key=F.col("class"))
    other = features(by_hand.apply(table(spark)))
    assert np.allclose(np.abs(slow - slow.mean(axis=0)), np.abs(other[:, :2] - other[:, :2].mean(axis=0)), atol=1e-3)
    assert np.allclose(rest.var(axis=0), other[:, 2:].var(axis=0), rtol=1e-3)


def test_parameters_go_where_they_are_declared(spark):
    layer = S.SlotLayer(pca="Whitening", last="SlowFeatures", parameters={"outputs": 3, "ridge": 0.5, "pca": {"outputs": 4}})
    assert S.routed(layer, "pca") == {"outputs": 4} and S.routed(layer, "last") == {"outputs": 3, "ridge": 0.5}
    with pytest.raises(ValueError, match="width"):
        S.routed(S.SlotLayer(parameters={"width": 1}), "last")

    class Half:
        @staticmethod
        def fit(state, factor=0.5):
            n = len(state.sx)
            return E.Linear(np.zeros(n), factor * np.eye(n), np.ones(n))

    S.register("Half", Half)
    shared = S.SlotLayer(((0, 1), (2, 3)), last="Half", shared=True, parameters={"factor": 2.0})
    got = features(S.apply_slots(table(spark), S.train_slots(table(spark), shared, "class")))
    assert np.allclose(got, 2 * X[:, :4])
    del S.CLASSES["Half"]


def test_nearest_neighbours_are_the_same_by_either_way(spark):
    q = table(spark).select(F.col("sample_id").alias("query_id"), "features")
    r = table(spark).select(F.col("sample_id").alias("reference_id"), "features")
    key = lambda rows: {(x["query_id"], x["rank"]): x["reference_id"] for x in rows.collect()}
    assert key(H.nearest_neighbours(q, r, 3, True)) == key(NB.nearest(q, r, 3, True))


def test_models_with_slots_and_cut_offs_are_saved(spark, tmp_path):
    from driftline.operators import saving

    layer = S.SlotLayer(((0, 1, 2), (2, 3, 4)), pca="Whitening", last="SlowFeatures", parameters={"outputs": 2, "pca": {"outputs": 3}})
    models = [S.train_slots(table(spark), layer, "class"), C.fit_cut_off(table(spark), 2)]
    saving.save(spark, models, str(tmp_path / "m"))
    slots, cut = saving.load(spark, str(tmp_path / "m"))
    assert np.allclose(features(S.apply_slots(table(spark), slots)), features(S.apply_slots(table(spark), models[0])))
    assert all((a == b).all() for a, b in zip(cut.rotations, models[1].rotations, strict=True)) and slots.spec == layer


def test_codes_and_coins(spark):
    from driftline.sources import synthetic

    rows = spark.createDataFrame([(-5.0,), (-1.0,), (0.004,), (3.9,), (9.0,), (None,)], "g double")
    assert [r[0] for r in rows.select(synthetic.gender_code(F.col("g"))).collect()] == [0, 375, 500, 987, 999, 999]
    flips = [r[0] for r in spark.range(4000).select(synthetic.coin("id", seed=1)).collect()]
    assert 1850 < sum(flips) < 2150 and flips == [r[0] for r in spark.range(4000).repartition(3).orderBy("id").select(synthetic.coin("id", seed=1)).collect()]


def test_a_query_is_sent_once_to_a_shard(spark, monkeypatch):
    """Rows without clusters, of which balls leave nothing out: few rows are sent, and all distances by brute force."""
    monkeypatch.setattr(NB, "LEAST_ROWS", 60)
    x = np.round(np.random.default_rng(5).normal(size=(300, 24)), 2)
    x[:20] = x[0]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "reference_id long, features array<double>")
    index = NB.BallIndex(rows)
    assert index.shards <= 7 and len(index.pivots) == 17
    got = {(r["query_id"], r["rank"]): (r["reference_id"], r["distance2"]) for r in index.search(rows.withColumnRenamed("reference_id", "query_id"), 4, True).collect()}
    assert len(got) == 1200
    for k, v in enumerate(x):
        d = ((v - x) ** 2).sum(axis=1)
        for n, (e, i) in enumerate(sorted((e, i) for i, e in enumerate(d) if e > 0)[:4]):
            assert got[k, n + 1] == (i, e)
