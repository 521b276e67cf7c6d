"""Graphs as dense blocks beside edges, and parts of a sample set that keep their own graphs.

A block matrix is rows (i, j, cells): the weights from the nodes of block i to
those of block j, row by row, as one array. Blocks without a weight are left
out; a graph of few dense groups is a few long rows instead of many edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.graphs import pairs_within
from driftline.operators.moments import Moments, lists, matrix, merge, partial
from driftline.session import ship

#: Cells that a step of to_blocks fills at most (16 MB).
CELLS = 2_000_000


def to_blocks(edges: DataFrame, size: int) -> DataFrame:
    """(i, j, cells) of edges (src, dst, w) between nodes numbered from 0; weights of the same pair are added. size: nodes of a block."""
    ship(edges.sparkSession)
    rows = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    rows = rows.select(F.floor(F.col("src") / size).alias("i"), F.floor(F.col("dst") / size).alias("j"), (F.col("src") % size * size + F.col("dst") % size).alias("at"), "w")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of their block; the last block of a step waits, as it may go on."""
        key, last = None, np.zeros(size * size)
        step = max(1, CELLS // (size * size))

        def made(keys: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists(list(cells))], ["i", "j", "cells"])

        for whole in batches:
            for batch in (whole.slice(start, step) for start in range(0, whole.num_rows, step)):
                pairs = np.stack([batch.column(c).to_numpy() for c in ("i", "j")], axis=1)
                new = np.concatenate([[key is None or (pairs[0] != key).any()], (pairs[1:] != pairs[:-1]).any(axis=1)])
                keys = pairs[new] if key is None else np.concatenate([[key], pairs[new]])
                cells = np.zeros((len(keys), size * size))
                cells[0] = last
                cells[np.cumsum(new) - int(key is None), batch.column("at").to_numpy()] = batch.column("w").to_numpy()
                if len(keys) > 1:
                    yield made(keys[:-1], cells[:-1])
                key, last = keys[-1], cells[-1]
        if key is not None:
            yield made(key[None], last[None])

    return rows.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(fill, "i long, j long, cells array<double>")


def to_edges(blocks: DataFrame, size: int) -> DataFrame:
    """(src, dst, w) of every weight that is not 0."""
    rows = blocks.select("i", "j", F.posexplode("cells").alias("at", "w")).where("w != 0")
    return rows.select((F.col("i") * size + F.floor(F.col("at") / size)).alias("src"), (F.col("j") * size + F.col("at") % size).alias("dst"), "w")


def block_moments(samples: DataFrame, nodes: DataFrame, blocks: DataFrame, size: int, width: int) -> Moments:
    """Moments of samples (sample_id from 0, features of width components) on a graph in blocks; nodes (sample_id, v).

    The edges of a block are never made: sums of w (x - y)(x - y)' follow from
    the block's row and column sums and the product X' W Y.
    """
    ship(samples.sparkSession)
    rows = samples.select(F.floor(F.col("sample_id") / size).alias("block"), F.struct(F.col("sample_id") % size, "features").alias("x"))
    held = rows.groupBy("block").agg(F.sort_array(F.collect_list("x")).alias("x"))  # size rows at most
    left = held.select(F.col("block").alias("i"), F.col("x").alias("a"))
    right = held.select(F.col("block").alias("j"), F.col("x").alias("b"))

    def dense(rows: pa.Array) -> np.ndarray:
        out = np.zeros((size, width))
        at = rows.field(0).to_numpy()
        out[at] = rows.field(1).flatten().to_numpy().reshape(len(at), width)
        return out

    def add(s: Moments, batch: pa.RecordBatch) -> None:
        for k in range(batch.num_rows):
            w = batch.column("cells")[k].values.to_numpy().reshape(size, size)
            a, b = dense(batch.column("a")[k].values), dense(batch.column("b")[k].values)
            cross = a.T @ w @ b
            s.r += float(w.sum())
            s.sdd += (a * w.sum(axis=1)[:, None]).T @ a + (b * w.sum(axis=0)[:, None]).T @ b - cross - cross.T

    v = nodes.select(F.col("sample_id").alias("_n"), "v")
    weighed = samples.join(v, F.col("sample_id") == F.col("_n")).select("features", "v")
    own = partial(weighed, lambda s, b: s.nodes(matrix(b), b.column("v").to_numpy(zero_copy_only=False).astype(float)), width)
    met = partial(blocks.join(left, "i").join(right, "j").select("cells", "a", "b"), add, width)
    return merge(own.union(met), width)


def split_regular(samples: DataFrame, parts: int, seed: int = 0) -> DataFrame:
    """samples with part, by a hash of sample_id: every part of about the same size, its samples in their order (ord is counted anew by with_ord)."""
    return samples.withColumn("part", F.pmod(F.xxhash64("sample_id", F.lit(seed)), F.lit(parts)).cast("int"))


def split_groups(samples: DataFrame, group: Column, parts: int, seed: int = 0) -> DataFrame:
    """samples with part and place: each group (a block or a class) is dealt evenly over all parts by a seeded order, so that every part has a share of every group; place counts a part's samples of the group from 0.

    Groups are dealt by ranks within hash buckets, never sorted in one task as
    a whole: a bucket's ranks go on where the bucket before ended.
    """
    from pyspark.sql import Window as W

    rows = samples.withColumn("_g", group).withColumn("_h", F.xxhash64("sample_id", F.lit(seed)))
    rows = rows.withColumn("_b", F.pmod(F.shiftright("_h", 40), F.lit(64)))
    counts = rows.groupBy("_g", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_g").alias("_g2"), F.col("_b").alias("_b2"), before.alias("_before"))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("_g", "_b").orderBy("_h", "sample_id")) - 1)
    placed = ranked.join(counts, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_b") == F.col("_b2"))).withColumn("_r", F.col("_r") + F.col("_before"))
    return placed.withColumn("part", (F.col("_r") % parts).cast("int")).withColumn("place", F.floor(F.col("_r") / parts)).drop("_g", "_h", "_b", "_g2", "_b2", "_before", "_r")


def part_graph(rows: DataFrame, part: int, group: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a part's own clustered graph: all pairs of each group that the part holds, weight 1 / (size - 1), node weights 1; single samples have a loop of weight 1. Consistent for itself."""
    own = rows.where(F.col("part") == part).select("sample_id", group.alias("cluster"))
    pairs = pairs_within(own).where((F.col("sample_id") != F.col("dst")) | (F.col("n") == 1))
    return own.select("sample_id", F.lit(1.0).alias("v")), pairs.select(F.col("sample_id").alias("src"), "dst", (1.0 / F.greatest(F.col("n") - 1, F.lit(1))).alias("w"))
