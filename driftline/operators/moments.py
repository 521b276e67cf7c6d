"""First and second moments of samples and of their differences along a training graph.

Samples are rows (ord BIGINT, features ARRAY<DOUBLE>, ...). Each mode names a
graph of node and edge weights, but no mode lists its pairs: a sample goes to
at most two buckets of neighbours, or its class or block is summed up first.
Tasks hold one state of D squared numbers each; states are added in rounds of
ever fewer tasks, which stream them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import ship
from driftline.staging import settled

#: Rows of a bucket of neighbours, less the few that it shares with the next.
BUCKET = 4096


@dataclass
class Moments:
    """Sums: node weights q, weighted samples and their products; edge weights r, weighted products of differences."""

    q: float
    r: float
    sx: np.ndarray
    sxx: np.ndarray
    sdd: np.ndarray

    @staticmethod
    def zero(size: int) -> Moments:
        return Moments(0.0, 0.0, np.zeros(size), np.zeros((size, size)), np.zeros((size, size)))

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.q + other.q, self.r + other.r, self.sx + other.sx, self.sxx + other.sxx, self.sdd + other.sdd)

    def scaled(self, w: float) -> Moments:
        return Moments(self.q * w, self.r * w, self.sx * w, self.sxx * w, self.sdd * w)

    def nodes(self, x: np.ndarray, v: np.ndarray | float = 1.0) -> None:
        v = np.broadcast_to(np.asarray(v, float), len(x))
        self.q += float(v.sum())
        self.sx += v @ x
        self.sxx += (x * v[:, None]).T @ x

    def edges(self, d: np.ndarray, w: np.ndarray | float = 1.0) -> None:
        w = np.broadcast_to(np.asarray(w, float), len(d))
        self.r += float(w.sum())
        self.sdd += (d * w[:, None]).T @ d

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.q, self.r], self.sx, self.sxx.reshape(-1), self.sdd.reshape(-1)])

    @staticmethod
    def of(flat: np.ndarray, size: int) -> Moments:
        a, b = 2 + size, 2 + size + size * size
        return Moments(float(flat[0]), float(flat[1]), flat[2:a].copy(), flat[a:b].reshape(size, size).copy(), flat[b:].reshape(size, size).copy())

    def fix(self, unbiased: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean, covariance and second moment of differences."""
        mean = self.sx / self.q
        return mean, (self.sxx - self.q * np.outer(mean, mean)) / (self.q - bool(unbiased)), self.sdd / self.r if self.r else self.sdd


def matrix(batch: pa.RecordBatch | pa.Table, name: str = "features") -> np.ndarray:
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        raise ValueError(f"{name} has null vectors")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(rows: Sequence[np.ndarray]) -> pa.Array:
    """Arrays as a column of lists, without a Python object for each number."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(float) if len(rows) else np.zeros(0)))


def _row(state: Moments | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lists([state.flat()] if state is not None else [])], ["state"])


def partial(rows: DataFrame, add: Callable[[Moments, pa.RecordBatch], None], size: int) -> DataFrame:
    """(state) of each task, to which add adds each Arrow batch."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = state or Moments.zero(size)
                add(state, batch)
        yield _row(state)

    return rows.mapInArrow(run, "state array<double>")


#: Tasks of the first round that adds states; the second has one, or some for states of several keys.
ADDERS, KEYED = 32, 8


def add_up(partials: DataFrame, key: str | None = None) -> DataFrame:
    """The sums of the states, one for all or one for each value of key (an integer of few values): a task adds what it is given, one after another."""
    ship(partials.sparkSession)
    columns = [*([key] if key else []), "state"]
    kind = f"{key} int, state array<double>" if key else "state array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(key).to_pylist() if key else [0] * batch.num_rows
            column = batch.column("state")
            for k, name in enumerate(keys):
                state = column[k].values.to_numpy(zero_copy_only=False)
                sums[name] = sums[name] + state if name in sums else state.copy()
        yield pa.RecordBatch.from_arrays([*([pa.array(list(sums), pa.int32())] if key else []), lists(list(sums.values()))], columns)

    first, last = ([key], [key]) if key else ([], [])
    spread = [*first, F.pmod(F.hash("state"), F.lit(ADDERS))] if key else first
    out = partials.select(*columns).repartition(ADDERS, *spread).mapInArrow(run, kind)
    return out.repartition(KEYED if key else 1, *last).mapInArrow(run, kind)


def merge(partials: DataFrame, size: int) -> Moments:
    """The sum of all states. None: all zero."""
    found = add_up(partials).toArrow().column("state")
    if not len(found):
        return Moments.zero(size)
    return Moments.of(found[0].values.to_numpy(zero_copy_only=False), size)


def dimension(samples: DataFrame) -> int:
    """The size of the vectors, which must all have one; an empty table raises."""
    least, most = samples.agg(F.min(F.size("features")), F.max(F.size("features"))).first()
    if least is None or least != most or least < 0:
        raise ValueError(f"vectors must be there and of one size; found {least} to {most}")
    return least


def with_ord(rows: DataFrame, *by: Column) -> DataFrame:
    """rows with ord: their places 0, 1, ... in the order of by, without one task for all of them."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), *by).sortWithinPartitions(*by)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_serial", F.monotonically_increasing_id())
    # Places are told by partition, so what is counted here must be what is read later.
    ranged = settled(ranged)
    counts = sorted(ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_serial").alias("least")).collect())
    starts, start = [], 0
    for part, n, least in counts:
        starts.append((part, start - least))
        start += n
    table = F.broadcast(spark.createDataFrame(starts, "_part int, _shift long"))
    return ranged.join(table, "_part").withColumn("ord", F.col("_serial") + F.col("_shift")).drop("_part", "_serial", "_shift")


def neighbourhoods(samples: DataFrame, width: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray], Moments]) -> DataFrame:
    """(state) of work(features, ord, own) for each bucket of samples in order, with the width samples before and after it."""
    ship(samples.sparkSession)
    block = max(BUCKET, 2 * width)
    near = F.array_distinct(F.array(*[F.floor((F.col("ord") + k) / block) for k in (-width, 0, width)]))
    rows = samples.select("ord", "features", F.explode(near).alias("bucket")).where("bucket >= 0")

    def run(group: pa.Table) -> pa.Table:
        ord_ = group.column("ord").to_numpy()
        by = np.argsort(ord_, kind="stable")
        own = ord_[by] // block == group.column("bucket")[0].as_py()
        if not own.any():
            return pa.Table.from_batches([_row(None)])
        return pa.Table.from_batches([_row(work(matrix(group)[by], ord_[by], own))])

    return rows.groupBy("bucket").applyInArrow(run, "state array<double>")


def group_sums(samples: DataFrame, key: Column) -> DataFrame:
    """(key, n, total) of each group; a hot group meets as one row a batch."""
    ship(samples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, which = np.unique(batch.column("key").to_numpy(zero_copy_only=False), return_inverse=True)
                x = matrix(batch)
                total = np.zeros((len(keys), x.shape[1]))
                np.add.at(total, which, x)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.bincount(which)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["key", "n", "total"])

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"key": group.column("key")[:1], "n": [int(np.sum(group.column("n").to_numpy()))], "total": pa.array([matrix(group, "total").sum(axis=0).tolist()], pa.list_(pa.float64()))})

    schema = "key long, n long, total array<double>"
    return samples.select(key.cast("long").alias("key"), "features").mapInArrow(run, schema).groupBy("key").applyInArrow(add, schema)


# Modes. Each gives states whose sum is that of its graph.


def unlabelled(samples: DataFrame, size: int, weight: float = 1.0) -> DataFrame:
    return partial(samples.select("features"), lambda s, b: s.nodes(matrix(b), weight), size)


def regular(samples: DataFrame, size: int) -> DataFrame:
    """Consecutive samples, weights 1."""

    def work(x: np.ndarray, at: np.ndarray, own: np.ndarray) -> Moments:
        state = Moments.zero(size)
        state.nodes(x[own])
        state.edges((x[1:] - x[:-1])[own[:-1] & (np.diff(at) == 1)])
        return state

    return neighbourhoods(samples, 1, work)


def window(samples: DataFrame, size: int, width: int, rows: int, both_ways: bool = False) -> DataFrame:
    """Samples up to width apart; node weights fall to a half at both ends. rows: their number, over 2 * width.

    The sum of node weights is counted as rows - (width - 1) / 2, as the
    method is defined; the ramps themselves sum to one less.
    """
    if 2 * width >= rows:
        raise ValueError(f"a window of {width} needs more than {rows} samples")

    def work(x: np.ndarray, at: np.ndarray, own: np.ndarray) -> Moments:
        state = Moments.zero(size)
        ramp = np.minimum(np.minimum(at + width, rows - 1 - at + width), 2 * width) / (2 * width)
        state.nodes(x[own], ramp[own])
        state.q += float(own[at == 0].sum())
        for d in range(1, width + 1):
            state.edges((x[d:] - x[:-d])[own[:-d]], 1.0 + both_ways)
        return state

    return neighbourhoods(samples, width, work)


def truncating_window(samples: DataFrame, size: int, width: int, rows: int) -> DataFrame:
    """Samples up to width apart, both ways; node weights 1, and nothing beyond the ends."""
    if 2 * width >= rows:
        raise ValueError(f"a window of {width} needs more than {rows} samples")

    def work(x: np.ndarray, at: np.ndarray, own: np.ndarray) -> Moments:
        state = Moments.zero(size)
        state.nodes(x[own])
        for d in range(1, width + 1):
            state.edges((x[d:] - x[:-d])[own[:-d]], 2.0)
        return state

    return neighbourhoods(samples, width, work)


def mirror_window(samples: DataFrame, size: int, width: int, rows: int) -> DataFrame:
    """As window in both directions, the sequence mirrored at both ends, node weights 1."""
    if 2 * width >= rows:
        raise ValueError(f"a window of {width} needs more than {rows} samples")

    def work(x: np.ndarray, at: np.ndarray, own: np.ndarray) -> Moments:
        state = Moments.zero(size)
        state.nodes(x[own])
        mine = np.flatnonzero(own)
        for d in [*range(-width, 0), *range(1, width + 1)]:
            other = at[mine] + d
            other = np.where(other < 0, -1 - other, np.where(other >= rows, 2 * rows - 1 - other, other))
            state.edges(x[other - at[0]] - x[mine])
        return state

    return neighbourhoods(samples, width, work)


def clustered(samples: DataFrame, size: int, key: Column, weight: float | Column = 1.0, loops: bool = True) -> DataFrame:
    """All pairs within each group of key, a pair's weight 1 / n of its group (1 / (n - 1) without loops, which changes all by that factor).

    weight: of every sample and its pairs; it must be the same within a group.
    """
    rows = samples.withColumn("_w", weight if isinstance(weight, Column) else F.lit(float(weight)))

    def inner(s: Moments, b: pa.RecordBatch) -> None:
        x, w = matrix(b), b.column("_w").to_numpy(zero_copy_only=False)
        s.nodes(x, w)
        if loops:
            s.edges(x, 2 * w)
            s.r -= float(w.sum())

    sums = group_sums(rows, key)
    if isinstance(weight, Column):
        weights = rows.groupBy(key.cast("long").alias("k")).agg(F.max("_w").alias("_w"))
        sums = sums.join(weights, sums["key"] == weights["k"])
    else:
        sums = sums.withColumn("_w", F.lit(float(weight)))

    def outer(s: Moments, b: pa.RecordBatch) -> None:
        n, w = b.column("n").to_numpy().astype(float), b.column("_w").to_numpy(zero_copy_only=False)
        t = matrix(b, "total")
        s.sdd -= (t * (2 * w / n)[:, None]).T @ t

    if loops:
        return partial(rows.select("features", "_w"), inner, size).union(partial(sums.select("n", "total", "_w"), outer, size))
    counts = sums.select(F.col("key").alias("_k"), "n")
    joined = rows.join(counts, key.cast("long") == F.col("_k"))

    def inner_free(s: Moments, b: pa.RecordBatch) -> None:
        x, w, n = matrix(b), b.column("_w").to_numpy(zero_copy_only=False), b.column("n").to_numpy().astype(float)
        f = np.where(n > 1, n / np.maximum(n - 1, 1), 0)
        s.nodes(x, w)
        s.edges(x, 2 * w * f)
        s.r -= float((2 * w * f).sum()) - float(w[n > 1].sum())

    def outer_free(s: Moments, b: pa.RecordBatch) -> None:
        n, w = b.column("n").to_numpy().astype(float), b.column("_w").to_numpy(zero_copy_only=False)
        t = matrix(b, "total")
        s.sdd -= (t * np.where(n > 1, 2 * w / np.maximum(n - 1, 1), 0)[:, None]).T @ t

    return partial(joined.select("features", "_w", "n"), inner_free, size).union(partial(sums.select("n", "total", "_w"), outer_free, size))


def in_blocks(samples: DataFrame, block: int) -> DataFrame:
    """(features, key, n, before, after) of samples: their block of the order, and how many samples it, the one before and the one after hold, as counted."""
    key = F.floor(F.col("ord") / block)
    held = samples.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    none = F.lit(0).cast("long")
    told = held.select("key", "n", none.alias("before"), none.alias("after"))
    told = told.union(held.select(F.col("key") + 1, none, "n", none)).union(held.select(F.col("key") - 1, none, none, "n"))
    told = told.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "before", "after")]).where("n > 0")
    return samples.select("features", key.alias("key")).join(told, "key").select("features", "key", "n", "before", "after")


def serial(samples: DataFrame, size: int, block: int, rows: int, weight: float = 1.0, rest: bool = False, evenly: bool = False) -> DataFrame:
    """All pairs of samples in adjacent blocks of the order, both ways, weight 1 / block; node weights 1 in the first and last whole block, else 2.

    rest: what is left after the whole blocks is a shorter one; without it, that
    raises. Where ord has gaps, a block has the samples that are there. evenly:
    each pair of blocks counts the same, so a pair of samples has the weight block
    over the product of its blocks' sizes; of whole blocks that is 1 / block too.
    """
    if rows <= block or (rows % block and not rest):
        raise ValueError(f"{rows} samples are not two or more whole blocks of {block}")
    last = rows // block - 1

    def inner(s: Moments, b: pa.RecordBatch) -> None:
        k, n, before, after = (b.column(c).to_numpy() for c in ("key", "n", "before", "after"))
        v = np.where((k == 0) | (k == last), 1.0, 2.0) * weight
        near = (np.sign(before) + np.sign(after)) * block / n if evenly else (before + after) / block
        x = matrix(b)
        s.nodes(x, v)
        s.edges(x, 2 * weight * near)
        s.r -= weight * float(near.sum())

    sums = group_sums(samples, F.floor(F.col("ord") / block))
    after = sums.select((F.col("key") - 1).alias("key"), F.col("n").alias("more"), F.col("total").alias("next"))

    def outer(s: Moments, b: pa.RecordBatch) -> None:
        pairs = b.column("n").to_numpy() * b.column("more").to_numpy()
        w = block / pairs if evenly else np.full(len(pairs), 1 / block)
        cross = (matrix(b, "total") * w[:, None]).T @ matrix(b, "next")
        s.sdd -= (cross + cross.T) * (2 * weight)

    return partial(in_blocks(samples, block), inner, size).union(partial(sums.join(after, "key").select("n", "more", "total", "next"), outer, size))


def mixed(samples: DataFrame, size: int, block: int, rows: int, rest: bool = False) -> DataFrame:
    """serial, and all pairs within each block, weight 1 / block, doubly in the first and last whole one; node weights 3."""
    doubled = lambda k: np.where((k == 0) | (k == rows // block - 1), 2.0, 1.0)

    def inner(s: Moments, b: pa.RecordBatch) -> None:
        k, n = (b.column(c).to_numpy() for c in ("key", "n"))
        near = doubled(k) * n / block
        x = matrix(b)
        s.nodes(x, doubled(k))
        s.edges(x, 2 * near)
        s.r -= float(near.sum())

    def outer(s: Moments, b: pa.RecordBatch) -> None:
        t = matrix(b, "total")
        s.sdd -= (t * (2 * doubled(b.column("key").to_numpy()) / block)[:, None]).T @ t

    sums = group_sums(samples, F.floor(F.col("ord") / block))
    within = partial(in_blocks(samples, block), inner, size).union(partial(sums.select("key", "total"), outer, size))
    return serial(samples, size, block, rows, rest=rest).union(within)


def dual_serial(samples: DataFrame, size: int, block: int, second_block: int, rows: int, second_weight: float = 0.0) -> DataFrame:
    """serial twice with two sizes of block; the second counts for nothing unless a weight is given."""
    first = serial(samples, size, block, rows)
    return first.union(serial(samples, size, second_block, rows, second_weight)) if second_weight else first


def graph(samples: DataFrame, size: int, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (sample_id, v), edges (src, dst, w): any graph. samples have sample_id."""
    x = samples.select("sample_id", "features")
    weighed = x.join(nodes.select(F.col("sample_id").alias("_n"), "v"), F.col("sample_id") == F.col("_n")).select("features", "v")
    ends = edges.join(x.select(F.col("sample_id").alias("src"), F.col("features").alias("a")), "src").join(x.select(F.col("sample_id").alias("dst"), F.col("features").alias("b")), "dst")
    number = lambda b, c: b.column(c).to_numpy(zero_copy_only=False).astype(float)
    return partial(weighed, lambda s, b: s.nodes(matrix(b), number(b, "v")), size).union(
        partial(ends.select("a", "b", "w"), lambda s, b: s.edges(matrix(b, "b") - matrix(b, "a"), number(b, "w")), size)
    )


def compact_labels(classes: int, labels: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels +1 or -1 of each class (a power of two of them), and the weights of the labels.

    A label belongs to a set of the bits of a class's number: +1 where the
    class has an odd number of them, else -1. The sets of one bit come first,
    the highest bit before the lower ones, with equal weights; further ones
    hold several bits, those of many bits before those of few and, of equally
    many, the set of the lesser number first. Their weights fall evenly.
    """
    bits = classes.bit_length() - 1
    if classes < 2 or classes != 1 << bits:
        raise ValueError(f"{classes} classes are not a power of two")
    wanted = bits if labels is None else labels
    single = [1 << b for b in reversed(range(bits))]
    several = sorted((s for s in range(1, classes) if s & (s - 1)), key=lambda s: (-s.bit_count(), s))
    sets = (single + several)[: max(wanted, bits)]
    if len(sets) < wanted:
        raise ValueError(f"{classes} classes have {len(sets)} labels, not {wanted}")
    table = np.array([[1 if (c & s).bit_count() % 2 else -1 for s in sets] for c in range(classes)])
    falling = len(sets) - bits + 1  # the last single bit and all others
    weights = np.array([1.0] * (bits - 1) + [1 - k / falling for k in range(falling)])
    return table, weights / weights.sum()


def compact_classes(samples: DataFrame, size: int, block: int, rows: int, labels: int | None = None, rest: bool = False) -> DataFrame:
    """Two clusters for each of the labels of compact_labels; a class is a block of the order. rest: what is left after the last class goes on with the first; without it, that raises."""
    if not 0 < block <= rows or (rows % block and not rest):
        raise ValueError(f"{rows} samples are not whole blocks of {block}")
    table, weights = compact_labels(rows // block, labels)
    out = None
    for j, w in enumerate(weights.tolist()):
        sign = F.element_at(F.array(*[F.lit(int(x)) for x in table[:, j]]), (F.floor(F.col("ord") / block) % (rows // block) + 1).cast("int"))
        states = clustered(samples, size, sign, w)
        out = states if out is None else out.union(states)
    return out


def with_unlabelled(labelled: Moments, more: DataFrame, share: float = 0.2, inner_weight: float = -0.025) -> Moments:
    """Adds unlabelled samples that take a share of the node weight: tied to all labelled ones, and among themselves with a weight."""
    size = len(labelled.sx)
    new = merge(unlabelled(more, size), size)
    n1, n2 = labelled.q, new.q
    v2 = n1 * share / n2
    w1, w12 = n1 / labelled.r * (1 - share), v2 / n1
    cross = np.outer(labelled.sx, new.sx)
    ties = 2 * (new.sxx * n1 - cross - cross.T + labelled.sxx * n2)
    inner = Moments(n2, n2, new.sx, new.sxx, 2 * (new.sxx - np.outer(new.sx, new.sx) / n2)).scaled(inner_weight)
    return Moments(n1 + v2 * n2, labelled.r * w1 + w12 * 2 * n1 * n2, labelled.sx + v2 * new.sx, labelled.sxx + v2 * new.sxx, labelled.sdd * w1 + w12 * ties) + inner


def with_unlabelled_in_classes(labelled: Moments, more: DataFrame, classes: int = 10, weight: float = 2**-9.5) -> Moments:
    """Adds unlabelled samples that belong to every class a little: each has the weight in all, evenly over the classes.

    The labelled samples lie in classes of one size. Within a class all pairs
    are tied by the product of their weights, over what a sample reaches; the
    labelled ones' node weights stay 1.
    """
    size = len(labelled.sx)
    new = merge(unlabelled(more, size), size)
    n1, n2, share = labelled.q / classes, new.q, weight / classes
    reach1, reach2 = n1 - 1 + share * n2, n1 + share * (n2 - 1)
    tie, inner = share * (1 / reach1 + 1 / reach2), share**2 / reach2 * (n2 - 1) * classes
    cross = np.outer(labelled.sx, new.sx)
    ties = tie * (new.sxx * labelled.q - cross - cross.T + labelled.sxx * n2)
    among = inner * 2 * (new.sxx - np.outer(new.sx, new.sx) / n2)
    old = labelled.scaled((n1 - 1) / reach1)
    return Moments(labelled.q + weight * n2, old.r + labelled.q * n2 * tie + inner * n2, labelled.sx + weight * new.sx, labelled.sxx + weight * new.sxx, old.sdd + ties + among)


def states_of(samples: DataFrame, mode: str, *, size: int | None = None, block: int | None = None, key: Column | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, labels: int | None = None, rest: bool = False) -> DataFrame:
    """(state) of samples under a mode, by its name; their sum are its moments.

    regular, unlabeled, clustered (with key or block), classification (key),
    serial, serial_regression (samples ordered by key first, those without one last), mixed,
    dual_serial, window<w>, fwindow<w>, mirror_window<w>, smirror_window<w>, truncating_window<w>,
    graph, compact_classes<J>, ignore_data. Another name raises ValueError, as do
    rows that are no whole blocks of serial, mixed and compact_classes without rest.
    """
    import re

    size = size or dimension(samples)
    rows = samples.count()
    named = re.fullmatch(r"(f|mirror_|smirror_|truncating_)?window(\d+)", mode)
    blocks = F.floor(F.col("ord") / block) if block else None
    if mode == "ignore_data":
        return samples.sparkSession.createDataFrame([], "state array<double>")
    if mode == "regular":
        states = regular(samples, size)
    elif mode == "unlabeled":
        states = unlabelled(samples, size)
    elif mode in ("clustered", "classification"):
        states = clustered(samples, size, blocks if key is None else key)
    elif mode == "serial":
        states = serial(samples, size, block, rows, rest=rest)
    elif mode == "serial_regression":
        states = serial(with_ord(samples.drop("ord"), key.asc_nulls_last(), F.col("sample_id")), size, block, rows, rest=rest)
    elif mode == "mixed":
        states = mixed(samples, size, block, rows, rest)
    elif mode == "dual_serial":
        states = dual_serial(samples, size, block, block, rows)
    elif named:
        width = int(named[2])
        states = truncating_window(samples, size, width, rows) if named[1] == "truncating_" else mirror_window(samples, size, width, rows) if "mirror" in (named[1] or "") else window(samples, size, width, rows, named[1] == "f")
    elif mode in ("graph", "graph_old"):
        states = graph(samples, size, nodes, edges)
    elif mode.startswith("compact_classes"):
        states = compact_classes(samples, size, block, rows, int(mode[15:]) if mode[15:] else labels, rest)
    else:
        raise ValueError(f"no training mode is called {mode}")
    return states


def train(samples: DataFrame, mode: str | Sequence[str | tuple[str, dict]], **graph) -> Moments:
    """The moments of samples under a mode, or the sum of those under several, which are added up in one pass.

    mode: a name that states_of knows, or a list of names and of pairs (name,
    its own arguments); graph are the arguments of all.
    """
    graph = {**graph, "size": graph.get("size") or dimension(samples)}
    several = [mode] if isinstance(mode, str) else list(mode)
    states = None
    for one in several:
        name, own = (one, {}) if isinstance(one, str) else one
        made = states_of(samples, name, **{**graph, **own})
        states = made if states is None else states.union(made)
    return Moments.zero(graph["size"]) if states is None else merge(states, graph["size"])


# Slowness.


def deltas(state: Moments, normalised: bool = False) -> np.ndarray:
    """The mean squared difference of each component along the graph; normalised: at variance 1."""
    out = np.diag(state.sdd) / state.r
    return out / np.diag(state.fix()[1]) if normalised else out


def eta(rows: int, delta: np.ndarray) -> np.ndarray:
    """How often a sine of the same delta would swing over so many rows."""
    return rows / (2 * np.pi) * np.sqrt(delta)


def typical_deltas(samples: DataFrame, mode: str, block: int | None = None, key: Column | None = None, rest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Deltas and etas that a sequence drawn along the mode has on average.

    serial and mixed: one sample of each block after another, by any draw (rest: a shorter last block too);
    clustered, classification and compact_classes: two different samples of a
    group; others: the samples in their order.
    """
    size, rows = dimension(samples), samples.count()
    if mode in ("serial", "mixed"):
        delta = deltas(merge(serial(samples, size, block, rows, rest=rest, evenly=True), size))
        return delta, eta(-(-rows // block), delta)
    if mode in ("clustered", "classification", "compact_classes"):
        groups = F.floor(F.col("ord") / block) if key is None else key
        delta = deltas(merge(clustered(samples, size, groups, loops=False), size))
    else:
        delta = deltas(merge(regular(samples, size), size))
    return delta, eta(rows, delta)
