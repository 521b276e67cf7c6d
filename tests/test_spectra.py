"""Leading responses of graphs against numpy on the whole matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import graphs as G
from driftline.operators import spectra as S


def random_graph(spark, n, edges, seed, uniform=False):
    rng = np.random.default_rng(seed)
    pairs = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, n, edges), rng.integers(0, n, edges), rng.random(edges) + 0.2, strict=True)}
    v = np.ones(n) if uniform else rng.random(n) + 0.5
    return v, pairs, spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "sample_id long, v double"), spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "src long, dst long, w double")


def whole(v, pairs):
    m = np.zeros((len(v), len(v)))
    for (a, b), w in pairs.items():
        m[a, b] += w / 2
        m[b, a] += w / 2
    return m / np.sqrt(np.outer(v, v))


def arrays(table, name="response"):
    rows = sorted(table.collect())
    return np.array([r[name] for r in rows])


def test_without_constant_against_numpy(spark):
    v, pairs, nodes, edges = random_graph(spark, 80, 500, 1)
    values, vectors = np.linalg.eigh(whole(v, pairs))
    got = S.leading_responses(nodes, edges, 4, constant=False)
    assert np.allclose(got.values, values[::-1][:4], atol=1e-9)
    y = arrays(got.table)
    q, r = v.sum(), sum(pairs.values())
    assert np.allclose(got.deltas, 2 - 2 * values[::-1][:4] * q / r)
    for k in range(4):
        assert abs(abs((y[:, k] * np.sqrt(v / q)) @ vectors[:, -1 - k]) - 1) < 1e-5
    assert (y[0] <= 0).all() and np.allclose((y.T * v) @ y / q, np.eye(4), atol=1e-7)


def test_a_graph_that_is_not_consistent_raises(spark):
    _, _, nodes, edges = random_graph(spark, 70, 400, 2)
    with pytest.raises(ValueError, match="not consistent"):
        S.leading_responses(nodes, edges, 4)


def test_node_weights_that_differ(spark):
    """A random graph whose node weights are the sums of its edges: consistent, the constant is the slowest."""
    _, pairs, _, edges = random_graph(spark, 70, 500, 6)
    w = np.zeros((70, 70))
    for (a, b), x in pairs.items():
        w[a, b] += x / 2
        w[b, a] += x / 2
    v = w.sum(axis=1)
    nodes = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "sample_id long, v double")
    values = np.linalg.eigvalsh(w / np.sqrt(np.outer(v, v)))[::-1]
    got = S.leading_responses(nodes, edges, 4)
    y = arrays(got.table)
    assert (y[:, 0] == 1).all() and np.allclose(got.values, values[:4], atol=1e-8)
    assert np.allclose((y.T * v) @ y / v.sum(), np.eye(4), atol=1e-7)


def test_consistent_graph(spark):
    """A chain of blocks, whose deltas have a closed form and are those of the responses along the edges."""
    nodes, edges = G.serial(spark, 120, 10)
    got = S.leading_responses(nodes, edges, 5)
    assert np.allclose(got.deltas, 2 - 2 * np.cos(np.pi * np.arange(5) / 11), atol=1e-9)
    along = {r["i"]: r["delta"] for r in G.graph_deltas(got.table.withColumnRenamed("response", "features"), edges).collect()}
    assert np.allclose([along[k] for k in range(5)], got.deltas, atol=1e-7)


def test_tables_and_arrays_take_the_same_steps(spark):
    """One round of either way from the same block: products, Gram matrix, change and filter."""
    _, _, nodes, edges = random_graph(spark, 40, 200, 7, uniform=True)
    graph = G.normalised(nodes, G.symmetric(edges)).select("src", "dst", "w")
    roots = nodes.select("sample_id", F.sqrt(F.col("v") / 40).alias("s"))
    one, two = S._Tables(graph, roots, 3, 5), S._Arrays(graph, roots, 3, 5)
    change = np.random.default_rng(1).normal(size=(7, 3))
    assert np.allclose(one.gram(), two.gram())
    for way in (one, two):
        way.turn(change)
        way.filter(S._steps(-3.0, 0.5, 2.0)[:3])
    assert np.allclose(arrays(one.table(), "x"), arrays(two.table(), "x"))


def test_many_nodes(spark):
    """Twenty loosely tied groups of 1000 nodes each; the response tells the groups apart."""
    n, groups = 10_000, 10
    rng = np.random.default_rng(5)
    group = np.arange(n) // (n // groups)
    src = np.repeat(np.arange(n), 4)
    dst = np.where(rng.random(len(src)) < 0.98, group[src] * (n // groups) + rng.integers(0, n // groups, len(src)), rng.integers(0, n, len(src)))
    import pandas as pd

    edges = spark.createDataFrame(pd.DataFrame({"src": src, "dst": dst, "w": 1.0}))
    edges = edges.union(edges.select("dst", "src", "w"))
    nodes = edges.groupBy(F.col("src").alias("sample_id")).agg(F.sum("w").alias("v"))
    got = S.leading_responses(nodes, edges, 4, tolerance=1e-5)
    assert (got.values[1:] > 0.9).all() and got.deltas[0] == pytest.approx(0)
    y = arrays(got.table)
    inside = sum(y[group == g, 1:].var(axis=0) for g in range(groups)) / groups
    assert (inside < 0.3 * y[:, 1:].var(axis=0)).all()


def test_there_and_back(spark):
    v, pairs, nodes, edges = random_graph(spark, 40, 200, 3)
    got = S.leading_responses(nodes, edges, 3, constant=False)
    vectors = S.eigenvectors_of(got.table, nodes)
    e = arrays(vectors, "vector")
    assert np.allclose(e.T @ e, np.eye(3), atol=1e-7)
    assert np.allclose(arrays(S.responses_of(vectors, nodes)), arrays(got.table), atol=1e-9)


def test_constant_beside_any_vectors(spark):
    v, _, nodes, _ = random_graph(spark, 30, 10, 4)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 3))
    x[:, 2] = 2 * x[:, 1]
    table = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "sample_id long, vector array<double>")
    e = arrays(S.with_constant(table, nodes), "vector")
    assert e.shape == (30, 3) and np.allclose(e[:, 0], np.sqrt(v / v.sum())) and np.allclose(e.T @ e, np.eye(3), atol=1e-9)


def test_too_few_nodes_raise(spark):
    with pytest.raises(ValueError, match="responses"):
        S.leading_responses(*random_graph(spark, 3, 4, 1)[2:], 5)
