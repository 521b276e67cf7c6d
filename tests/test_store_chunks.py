"""Stages found by content, and chunks of a series against the whole."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import moments as M
from driftline.operators import stagestore as S
from driftline.plans import network as N
from driftline.streaming import chunks as C


def table(spark, n=60, size=4, seed=1, change=0.0):
    x = np.random.default_rng(seed).normal(size=(n, size))
    x[3, 2] += change
    return spark.createDataFrame([(k, k, k % 3, [float(v) for v in r]) for k, r in enumerate(x)], "sample_id long, ord long, class int, features array<double>")


def features(rows):
    return np.array([r["features"] for r in sorted(rows.collect())])


def test_content_digest(spark):
    a = table(spark)
    same = S.content_digest(a)
    assert S.content_digest(a.repartition(7).select(*reversed(a.columns))) == same
    assert len({same, S.content_digest(table(spark, change=1e-9)), S.content_digest(a.union(a.limit(1))), S.content_digest(a.withColumnRenamed("ord", "place")), S.content_digest(a.withColumn("ord", F.col("ord").cast("int"))), S.content_digest(a.where("ord < 59")), S.content_digest(a.where("false"))}) == 7
    odd = spark.createDataFrame([(None, {"b": 1, "a": 2}, float("nan"))], "x int, m map<string,int>, y double")
    assert S.content_digest(odd) == S.content_digest(odd) != S.content_digest(odd.withColumn("x", F.lit(1)))


def test_spec_digest():
    layer = N.Layer(None, 3)
    assert S.spec_digest(layer) == S.spec_digest(N.Layer(None, 3)) != S.spec_digest(replace(layer, outputs=2))
    assert S.spec_digest({"a": 1, "b": np.arange(3)}) == S.spec_digest({"b": np.arange(3), "a": 1}) != S.spec_digest({"a": 1, "b": np.arange(3.0)})
    assert S.spec_digest(1) != S.spec_digest(1.0) != S.spec_digest("1") and S.spec_digest(np.mean) == S.spec_digest(np.mean)
    with pytest.raises(TypeError):
        S.spec_digest(lambda x: x)


def test_a_second_training_reads(spark, tmp_path, monkeypatch):
    trained = []
    original = S.train_layer
    monkeypatch.setattr(S, "train_layer", lambda *a: trained.append(a[1]) or original(*a))
    network = N.Network("two", (N.Layer(((0, 1), (2, 3)), 2), N.Layer(None, 2)))
    store = S.StageStore(spark, str(tmp_path))
    models, out = S.network_through(store, table(spark), network, "class")
    assert len(trained) == 2 and {k for k, *_ in store.log} == {"made"}
    want = features(out)
    assert np.allclose(want, features(N.train_network(table(spark), network, "class")[1]))
    store.log.clear()
    again, out = S.network_through(store, table(spark).repartition(5), network, "class")
    assert len(trained) == 2 and [k for k, *_ in store.log] == ["read"] * 4 and (features(out) == want).all()
    assert (again[1].models[0].weights == models[1].models[0].weights).all()
    S.network_through(store, table(spark, change=0.5), network, "class")
    assert len(trained) == 4  # one number of one row
    S.network_through(store, table(spark), replace(network, layers=(network.layers[0], replace(network.layers[1], outputs=1))), "class")
    assert len(trained) == 5  # the first layer is that of before


def test_outputs_of_new_samples_are_held(spark, tmp_path):
    store = S.StageStore(spark, str(tmp_path))
    models, _ = N.train_network(table(spark), N.Network("one", (N.Layer(None, 2),)), "class")
    a = S.applied_through(store, table(spark, seed=9), models).collect()
    store.log.clear()
    assert sorted(a) == sorted(S.applied_through(store, table(spark, seed=9), models).collect()) and store.log[0][0] == "read"
    name = store.log[0][2]
    store.forget("table", name)
    assert not store.holds("table", name)


@pytest.mark.parametrize(("cuts", "width"), [((7, 30, 31), 1), ((20,), 3), ((1, 2, 3, 50), 3), ((), 2)])
def test_moments_over_any_cutting_are_those_of_the_whole(spark, tmp_path, cuts, width):
    rows = table(spark)
    fold = C.ChunkFold(spark, str(tmp_path / "f"), 4, width)
    ends = [0, *cuts, 60]
    for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        fold.add(rows.where((F.col("ord") >= a) & (F.col("ord") < b)), k)
        if k == 1:
            fold.add(rows.where((F.col("ord") >= a) & (F.col("ord") < b)), k)  # a batch that runs again
    got = fold.moments("regular" if width == 1 else "window")
    want = M.train(rows, "regular") if width == 1 else M.train(rows, f"window{width}")
    for a, b in zip((got.q, got.r, got.sx, got.sxx, got.sdd), (want.q, want.r, want.sx, want.sxx, want.sdd), strict=True):
        assert np.allclose(a, b, atol=1e-9)
    assert fold.late().count() == 0


def test_late_rows_are_set_aside(spark, tmp_path):
    rows = table(spark)
    fold = C.ChunkFold(spark, str(tmp_path / "f"), 4)
    fold.add(rows.where("ord between 0 and 19 and ord != 5"), 0)
    fold.add(rows.where("ord = 5 or ord between 20 and 29"), 1)
    fold.add(rows.where("false"), 2)
    fold.add(rows.where("ord between 30 and 39"), 3)
    want = M.train(rows.where("ord < 40 and ord != 5"), "regular")
    assert np.allclose(fold.moments().sdd, want.sdd) and fold.moments().q == 39
    assert [r["ord"] for r in fold.late().collect()] == [5]


def test_a_stream_of_files(spark, tmp_path):
    rows = table(spark)
    for k in range(3):
        rows.where(f"ord div 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fold = C.ChunkFold(spark, str(tmp_path / "f"), 4)
    fold.follow(stream, str(tmp_path / "c")).awaitTermination()
    assert np.allclose(fold.moments().sdd, M.train(rows, "regular").sdd)


@pytest.mark.parametrize(("n", "size", "block", "continuous"), [(20, 3, 2, False), (20, 3, 2, True), (21, 3, 2, True), (18, 2, 1, True), (9, 4, 3, False), (6, 3, 2, True)])
def test_chunks_by_slicing(spark, n, size, block, continuous):
    want, at, k = set(), 0, 0
    while at < n and not (continuous and at and at + block >= n):
        want |= {(k, x) for x in range(at, min(at + size * block, n))}
        at += (size - (1 if continuous else 0)) * block
        k += 1
    got = C.chunked(spark.range(n).withColumnRenamed("id", "ord"), size, block, continuous)
    assert {(r["chunk"], r["ord"]) for r in got.collect()} == want
