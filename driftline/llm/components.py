"""Connected components of an edge table, by joins (large star, small star)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import giving_back, stage, unstage


class Forest:
    """Union-find over the few nodes one task holds; the smallest node is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.up.get(root, root)) != root:
            root = up
        while (up := self.up.get(x, x)) != root:
            self.up[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up.setdefault(a, a)
        self.up.setdefault(b, b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one Arrow batch as stars, fewer and shallower."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            forest.union(a, b)
        nodes = [x for x in forest.up if forest.find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (u, v: BIGINT); component is the smallest node.

    Edges with a null or with equal ends are ignored; repeated edges count
    once. No edges: no rows. The loop ends when the edges no longer change.
    """
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stage(now.mapInArrow(giving_back(_shrink), "u long, v long"), "edges")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        before, now = now, stage(_small_star(_large_star(now)), "edges")
        unstage(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
