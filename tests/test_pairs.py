"""Pairs of clusters: neither shuffled nor made in one task for a large cluster."""

import pytest
from pyspark.sql import functions as F

from driftline.operators import graphblocks as GB
from driftline.operators import graphs as G


def test_pairs_of_compact_classes_are_not_shuffled(spark):
    edges = G.compact_classes(spark, 4, 30)[1]
    assert "Exchange" not in edges._jdf.queryExecution().executedPlan().toString()
    got = {(r["src"], r["dst"]): r["w"] for r in edges.collect()}
    bits = lambda i: (i // 60, i // 30 % 2)
    for i in range(120):
        for j in range(120):
            w = sum(0.5 / 59 for a, b in zip(bits(i), bits(j), strict=True) if a == b) if i != j else 0
            assert got.get((i, j), 0) == pytest.approx(w)


def test_a_large_cluster_is_no_hot_task(spark, monkeypatch):
    monkeypatch.setattr(G, "PIECE", 16)
    members = spark.range(203).select(F.col("id").alias("sample_id"), F.when(F.col("id") < 200, 0).when(F.col("id") < 202, 1).otherwise(2).alias("cluster"))
    edges = G.clustered(members)[1].withColumn("task", F.spark_partition_id())
    assert edges.where("src < 200").select("task").distinct().count() > 1
    rows = edges.collect()
    assert len({(r["src"], r["dst"]) for r in rows}) == len(rows) == 200 * 199 + 2
    assert {round(r["w"], 9) for r in rows} == {1.0, round(1 / 199, 9)}


@pytest.mark.parametrize("cells", [3 * 16, 2_000_000])
def test_blocks_are_filled_some_at_a_time(spark, monkeypatch, cells):
    """Blocks that go on from step to step, without a call of Python for each."""
    monkeypatch.setattr(GB, "CELLS", cells)
    edges = spark.range(900).select((F.col("id") * 7 % 23).alias("src"), (F.col("id") * 5 % 19).alias("dst"), (1.0 + F.col("id") % 4).alias("w"))
    blocks = GB.to_blocks(edges, 4)
    assert "FlatMapGroups" not in blocks._jdf.queryExecution().executedPlan().toString()
    want = {(r["src"], r["dst"]): r["w"] for r in G.add_up(edges).collect()}
    rows = blocks.collect()
    assert len({(r["i"], r["j"]) for r in rows}) == len(rows)
    assert {(4 * r["i"] + k // 4, 4 * r["j"] + k % 4): w for r in rows for k, w in enumerate(r["cells"]) if w} == want
