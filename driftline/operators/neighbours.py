"""Exact nearest neighbours by balls around pivots: blocks that cannot hold a neighbour never meet.

Every reference row belongs to its nearest pivot; a ball knows how far its rows
reach. A query first looks into the ball of its nearest pivot, which tells how
near its k-th neighbour is at most; it then goes only to balls that reach
within that distance (triangle inequality). Balls of very many rows are cut
into blocks, so no task holds a ball whole; balls of few rows share a shard, and
a query is sent once to a shard, however many of its balls it may need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.operators.moments import matrix
from driftline.session import ship
from driftline.staging import settled

#: Pivots at most (they go to every task), rows of a block or shard, and queries that meet a block at a time.
PIVOTS, BLOCK_ROWS, QUERY_ROWS = 512, 20_000, 20_000
#: Rows of a shard of a small table, which is cut into some SHARDS of them.
LEAST_ROWS, SHARDS = 1_000, 8
#: Numbers that a step of differences holds at once (16 MB), and rows that a step sends.
STEP, SENT = 2_000_000, 20_000
#: Distances are floating-point numbers; balls are left out only if they are farther by this share.
MARGIN = 1e-9


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, by differences."""
    out = np.empty((len(a), len(b)))
    step = max(1, STEP // max(b.size, 1))
    for k in range(0, len(a), step):
        out[k : k + step] = ((a[k : k + step, None, :] - b[None]) ** 2).sum(axis=2)
    return out


def nearest_within(a: np.ndarray, b: np.ndarray, names: np.ndarray, apart: np.ndarray, most: np.ndarray, k: int, skip_same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, name, squared distance) of the k nearest rows of b of each row of a that are apart (rows, rows of b) and within its squared distance most; ties go to the lesser name.

    A product of matrices tells which may be among them; only those are compared by differences.
    """
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    about = a2[:, None] + b2[None] - 2 * (a @ b.T)
    slack = 1e-11 * (a2 + b2.max(initial=0.0)) + 1e-300  # far over what rounding does to the product
    about[~apart] = np.inf
    bound = most.copy()
    for row in np.flatnonzero(np.isinf(bound)):  # too few were near it: a k-th that is there and surely not the same
        sure = about[row][(about[row] > slack[row]) & np.isfinite(about[row])]
        if len(sure) >= k:
            bound[row] = np.partition(sure, k - 1)[k - 1] + slack[row]
    row, at = np.nonzero((about <= (bound * (1 + MARGIN) + slack)[:, None]) & apart)
    d = np.empty(len(row))
    step = max(1, STEP // max(b.shape[1], 1))
    for start in range(0, len(row), step):
        some = slice(start, start + step)
        d[some] = ((a[row[some]] - b[at[some]]) ** 2).sum(axis=1)
    if skip_same:
        row, at, d = row[d > 0], at[d > 0], d[d > 0]
    order = np.lexsort((names[at], d, row))
    row, at, d = row[order], at[order], d[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], names[at[place < k]], d[place < k]


def pivots(reference: DataFrame, count: int | None = None, seed: int = 0) -> np.ndarray:
    """About the root of the number of reference rows as pivots (at most PIVOTS), drawn by a hash of their ids."""
    n = reference.count()
    wanted = min(count or max(1, round(n**0.5)), PIVOTS, max(n, 1))
    rows = reference.orderBy(F.xxhash64("reference_id", F.lit(seed)), "reference_id").limit(wanted).select("features").collect()
    return np.array([r["features"] for r in rows], float) if rows else np.zeros((0, 0))


def _to_pivots(rows: DataFrame, at: np.ndarray, name: str) -> DataFrame:
    """rows (name, features) with home, the nearest pivot, and away, the distance to it."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = squared(matrix(batch), at)
                home = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(name), batch.column("features"), pa.array(home.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(d)), home]))], [name, "features", "home", "away"])

    return rows.select(F.col(name).cast("long").alias(name), "features").mapInArrow(run, f"{name} long, features array<double>, home int, away double")


class BallIndex:
    """The reference rows (reference_id, features) in balls; built once, searched any number of times."""

    def __init__(self, reference: DataFrame, count: int | None = None, seed: int = 0) -> None:
        self.pivots = pivots(reference, count, seed)
        #: (query, block) pairs of the last search, and those that a search without the index would have made.
        self.met, self.all_pairs = 0, 0
        if not len(self.pivots):
            self.rows = None
            return
        rows = settled(_to_pivots(reference, self.pivots, "reference_id"))
        sizes = rows.groupBy("home").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # a row for each pivot
        self.radius = np.full(len(self.pivots), -1.0)
        self.blocks = np.zeros(len(self.pivots), np.int64)
        for r in sizes:
            self.radius[r["home"]] = r["radius"]
            self.blocks[r["home"]] = -(-r["n"] // BLOCK_ROWS)
        table = F.array(*[F.lit(int(b)) for b in np.maximum(self.blocks, 1)])
        # Balls of one block are put together in shards, one after another; the blocks of larger ones are shards of their own.
        counts = np.zeros(len(self.pivots), np.int64)
        for r in sizes:
            counts[r["home"]] = r["n"]
        wanted = min(BLOCK_ROWS, max(LEAST_ROWS, int(counts.sum()) // SHARDS))
        self.shard, self.shards, held = np.zeros(len(self.pivots), np.int64), 0, wanted
        for ball, n in enumerate(counts.tolist()):
            if self.blocks[ball] > 1:
                self.shard[ball], held = self.shards, wanted
                self.shards += int(self.blocks[ball])
            elif n:
                if held + n > wanted:
                    self.shards, held = self.shards + 1, 0
                self.shard[ball], held = self.shards - 1, held + n
        self.rows = rows.withColumn("block", F.pmod(F.xxhash64("reference_id"), F.element_at(table, F.col("home") + 1)).cast("int"))

    def _meet(self, visits: DataFrame, k: int, skip_same: bool) -> DataFrame:
        """The k best of each visit: visits (query_id, features, home, block, part)."""
        parts = visits.groupBy("home", "block").agg(F.max("part").alias("last"))
        there = self.rows.join(F.broadcast(parts), ["home", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last"))))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, others, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            if left.num_rows and right.num_rows:
                a, b, names = matrix(left), matrix(right), right.column("reference_id").to_numpy()
                order = np.argsort(names, kind="stable")
                b, names = b[order], names[order]
                for start in range(0, len(a), 256):
                    d = squared(a[start : start + 256], b)
                    d = np.where(d <= 0, np.inf, d) if skip_same else d
                    best = np.argsort(d, axis=1, kind="stable")[:, :k]
                    near = np.take_along_axis(d, best, axis=1)
                    keep = np.isfinite(near)
                    ids.append(np.repeat(left.column("query_id").to_numpy()[start : start + 256], keep.sum(axis=1)))
                    others.append(names[best[keep]])
                    dist.append(near[keep])
            return pa.table({"query_id": np.concatenate(ids), "reference_id": np.concatenate(others), "distance2": np.concatenate(dist)})

        key = ["home", "block", "part"]
        return visits.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(run, "query_id long, reference_id long, distance2 double")

    def search(self, queries: DataFrame, k: int, skip_same: bool = False) -> DataFrame:
        """(query_id, reference_id, distance2, rank): the k nearest of each of queries (query_id, features), whose ids differ; ties go to the lesser id. skip_same leaves out distances of 0. No reference rows: no rows."""
        spark = queries.sparkSession
        if self.rows is None:
            return spark.createDataFrame([], "query_id long, reference_id long, distance2 double, rank int")
        at, radius, blocks, shard = self.pivots, self.radius, self.blocks, self.shard
        asked = settled(_to_pivots(queries, at, "query_id"))
        number = asked.count()
        # A query whose pivot's ball is empty of it still has a home: pivots are reference rows.
        split = max(1, -(-number // min(QUERY_ROWS, max(LEAST_ROWS, number // SHARDS))))
        part = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(split)).cast("int")
        numbers = lambda x: F.array(*[F.lit(int(b)) for b in x])
        home = asked.withColumn("block", F.explode(F.sequence(F.lit(0), (F.element_at(numbers(np.maximum(blocks, 1)), F.col("home") + 1) - 1).cast("int")))).withColumn("part", part)
        top = lambda rows: rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance2", "reference_id"))).where(F.col("rank") <= k)
        first = settled(top(self._meet(home, k, skip_same)))
        far = first.groupBy(F.col("query_id").alias("_q")).agg(F.max("distance2").alias("far"), F.count("*").alias("n"))
        limit = asked.join(far, F.col("query_id") == F.col("_q"), "left").withColumn("most", F.when(F.col("n") == k, F.col("far")).otherwise(float("inf")))
        own = np.unique(shard[blocks == 1])  # shards of whole balls
        ball_of = np.full(self.shards, -1)
        for ball in np.flatnonzero(blocks > 1):
            ball_of[shard[ball] : shard[ball] + blocks[ball]] = ball

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                step = max(1, SENT // max(len(ball_of), 1))
                for batch in (whole.slice(start, step) for start in range(0, whole.num_rows, step)):
                    d = np.sqrt(squared(matrix(batch), at))
                    limits = np.sqrt(batch.column("most").to_numpy(zero_copy_only=False))
                    reach = (d - radius[None]) * (1 - MARGIN) - MARGIN <= limits[:, None]
                    reach &= (blocks > 0)[None]
                    reach[np.arange(len(d)), batch.column("home").to_numpy()] = False
                    met = np.zeros((len(d), len(ball_of)), np.int32)
                    for s in own:
                        met[:, s] = reach[:, (shard == s) & (blocks == 1)].sum(axis=1)
                    for s in np.flatnonzero(ball_of >= 0):
                        met[:, s] = reach[:, ball_of[s]]
                    row, there = np.nonzero(met)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("query_id", "features", "home", "most")], pa.array(there.astype(np.int32)), pa.array(met[row, there])], ["query_id", "features", "home", "most", "shard", "met"])

        more = limit.select("query_id", "features", "home", "most").mapInArrow(visits, "query_id long, features array<double>, home int, most double, shard int, met int").withColumn("part", part)
        more = settled(more)
        self.met, self.all_pairs = home.count() + (more.agg(F.sum("met")).first()[0] or 0), number * int(blocks.sum())
        rows = self.rows.withColumn("shard", (F.element_at(numbers(shard), F.col("home") + 1) + F.col("block")).cast("int"))
        there = rows.select("shard", "reference_id", "features", "home").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, others, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            if left.num_rows and right.num_rows:
                a, b, names, balls = matrix(left), matrix(right), right.column("reference_id").to_numpy(), right.column("home").to_numpy()
                asking, homes, most = (left.column(c).to_numpy() for c in ("query_id", "home", "most"))
                for start in range(0, len(a), 256):
                    some = slice(start, start + 256)
                    row, other, d = nearest_within(a[some], b, names, homes[some][:, None] != balls[None], most[some], k, skip_same)
                    ids.append(asking[some][row])
                    others.append(other)
                    dist.append(d)
            return pa.table({"query_id": np.concatenate(ids), "reference_id": np.concatenate(others), "distance2": np.concatenate(dist)})

        by = lambda x: x.groupBy("shard", "part")
        found = by(more.drop("met")).cogroup(by(there)).applyInArrow(run, "query_id long, reference_id long, distance2 double")
        return settled(top(first.drop("rank").union(found)))


def nearest(queries: DataFrame, reference: DataFrame, k: int, skip_same: bool = False) -> DataFrame:
    """As heads.nearest_neighbours, through a BallIndex."""
    return BallIndex(reference).search(queries, k, skip_same)
