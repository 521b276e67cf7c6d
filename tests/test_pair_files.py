"""Pairs of clusters: all of them by tiles, and in an order that files keep in little room."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftline.operators import graphs as G


def bytes_a_pair(edges, folder) -> float:
    edges.write.parquet(str(folder))
    return sum(f.stat().st_size for f in Path(folder).glob("part-*")) / edges.sparkSession.read.parquet(str(folder)).count()


def test_files_of_compact_classes_are_small(spark, tmp_path):
    assert bytes_a_pair(G.compact_classes(spark, 4, 1501)[1], tmp_path / "edges") < 0.4


def test_files_of_clusters_are_small(spark, tmp_path):
    members = spark.range(6000).select(F.col("id").alias("sample_id"), (F.col("id") % 2).alias("cluster"))
    assert bytes_a_pair(G.clustered(members)[1], tmp_path / "edges") < 0.4


@pytest.mark.parametrize("size", [1, 16, 37, 100])
def test_compact_classes_by_tiles(spark, monkeypatch, size):
    """Classes that are no whole pieces and parts; an edge whose weight comes out 0 is still one."""
    monkeypatch.setattr(G, "PIECE", 16)
    monkeypatch.setattr(G, "PART", 2)
    monkeypatch.setattr(G, "TASK", 1000)
    edges = G.compact_classes(spark, 4, size, weigh=lambda w: w * 0)[1]
    of = lambda i: (i // (2 * size), i // size % 2)
    same = lambda i, j: any(a == b for a, b in zip(of(i), of(j), strict=True))
    want = Counter((i, j) for i in range(4 * size) for j in range(4 * size) if i != j and same(i, j))
    rows = edges.collect()
    assert Counter((r["src"], r["dst"]) for r in rows) == want and {r["w"] for r in rows} <= {0.0}
    assert edges.rdd.getNumPartitions() >= 16 * size * size / 1000
    assert G.compact_classes(spark, 4, 0)[1].count() == 0


def test_clusters_by_tiles(spark, monkeypatch):
    """Repeated, missing and single nodes, and nodes without a cluster; a cluster of many parts."""
    monkeypatch.setattr(G, "PIECE", 16)
    monkeypatch.setattr(G, "PART", 2)
    monkeypatch.setattr(G, "TASK", 1000)
    rows = [(i, "a") for i in range(203)] + [(7, "a"), (None, "a"), (300, "b"), (301, "b"), (400, "c"), (500, None), (501, None)]
    edges = G.clustered(spark.createDataFrame(rows, "sample_id long, cluster string"))[1]
    sizes = Counter(c for _, c in rows)
    want = Counter((i, j, round(1 / (sizes[c] - 1), 9)) for i, c in rows for j, d in rows if c and c == d and None not in (i, j) and i != j)
    assert Counter((r["src"], r["dst"], round(r["w"], 9)) for r in edges.collect()) == want
    assert edges.rdd.getNumPartitions() >= 205 * 205 / 1000


def test_pairs_of_compact_classes_are_not_gathered(spark):
    """No list of nodes is made: a pair follows from its number."""
    assert "Generate" not in G.compact_classes(spark, 4, 3000)[1]._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_clusters_are_made_a_piece_at_a_time(spark):
    """No pairs of a node with its whole cluster are made at once: the join streams."""
    members = spark.range(3000).select(F.col("id").alias("sample_id"), F.lit(0).alias("cluster"))
    assert "SortMergeJoin" in G.clustered(members)[1]._jdf.queryExecution().executedPlan().toString()
