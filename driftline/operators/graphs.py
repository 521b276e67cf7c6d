"""Training graphs as tables: nodes (sample_id, v), edges (src, dst, w); and exact label learning.

Generators work from the number of samples or from a table of clusters.
Graphs of exact label learning are dense by nature (N squared edges); their
moments need none of it, see ``label_moments``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.moments import Moments, compact_labels, merge, partial


def add_up(*edges: DataFrame) -> DataFrame:
    """All edges; weights of the same pair are added."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def scaled(edges: DataFrame, factor: float) -> DataFrame:
    return edges.withColumn("w", F.col("w") * factor)


def uniform_nodes(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("sample_id"), F.lit(1.0).alias("v"))


def linear(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """A chain in both directions, and loops of weight 1 at both ends; node weights 1. Each sample's edges sum to 2 ... its chain neighbours and loop."""
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    back = chain.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    ends = spark.range(2).select((F.col("id") * (n - 1)).alias("src"), (F.col("id") * (n - 1)).alias("dst"), F.lit(1.0).alias("w"))
    return uniform_nodes(spark, n), add_up(chain, back, ends)


#: Nodes of a piece of a cluster, and pieces of a part of it. Pairs are listed by tiles, a node of a part with all of one
#: piece: a file meets the same few nodes again and again, and keeps a pair in a small part of a byte.
PIECE, PART = 256, 64
#: Pairs that a task lists, about.
TASK = 1 << 23


def pairs_within(members: DataFrame, *more: Column) -> DataFrame:
    """members (sample_id, cluster): each node with n, the size of its cluster, more (columns of n), and dst, each node of it, itself too.

    A cluster's nodes are listed in pieces, and a part of the pieces meets each
    piece by itself, so a large cluster is no hot key. Pairs are made of lists
    where they are used, not shuffled: nodes are copied once for each piece,
    and more is computed once a copy. The join by sorting streams: what is made
    at once is a node's pairs with a piece.
    """
    spark = members.sparkSession
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n")).select(F.col("cluster").alias("_c"), "n", F.ceil(F.col("n") / PIECE).cast("int").alias("_pieces"))
    clusters, pairs = sizes.where("_c IS NOT NULL").agg(F.count("*"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil((pairs or 0) / TASK))
    sized = members.join(F.broadcast(sizes) if clusters <= 10_000 else sizes, F.col("cluster").eqNullSafe(F.col("_c")) & F.col("cluster").isNotNull()).drop("_c")
    lists = sized.withColumn("_piece", F.pmod(F.xxhash64("sample_id"), F.col("_pieces")).cast("int")).groupBy("cluster", "n", "_pieces", "_piece").agg(F.collect_list("sample_id").alias("_ids"))
    upto = lambda last: F.explode(F.sequence(F.lit(0), last.cast("int")))
    ones = lists.select("cluster", "n", *more, "_ids", F.floor(F.col("_piece") / PART).cast("int").alias("_part"), upto(F.col("_pieces") - 1).alias("_piece"))
    others = lists.select("cluster", F.col("_ids").alias("_others"), upto(F.floor((F.col("_pieces") - 1) / PART)).alias("_part"), "_piece")
    tile = ["cluster", "_part", "_piece"]
    ones = ones.repartition(shares, *tile).withColumn("sample_id", F.explode("_ids")).drop("_ids")
    return ones.join(others.repartition(shares, *tile).hint("merge"), tile).withColumn("dst", F.explode("_others")).drop("_part", "_piece", "_others")


def clustered(members: DataFrame, weigh: Callable[[Column], Column] = lambda w: w) -> tuple[DataFrame, DataFrame]:
    """members (sample_id, cluster): all pairs within each cluster, weight 1 / (size - 1), no loops; node weights 1. weigh: what becomes of a weight, once for many pairs."""
    edges = pairs_within(members, weigh(1.0 / F.greatest(F.col("n") - 1, F.lit(1))).alias("w")).where("sample_id != dst").select(F.col("sample_id").alias("src"), "dst", "w")
    return members.select("sample_id", F.lit(1.0).alias("v")), edges


def compact_classes(spark: SparkSession, classes: int, size: int, labels: int | None = None, weigh: Callable[[Column], Column] = lambda w: w) -> tuple[DataFrame, DataFrame]:
    """For each label of compact_labels its two clusters, weighted and added up; a class is size samples in a row. weigh: what becomes of a weight, once for many pairs.

    What two classes share tells the weight of all pairs between them, so the
    pairs are listed once: they are numbered tile by tile, and a pair's number
    tells its nodes. Nothing is shuffled, and no list is made.
    """
    table, weights = compact_labels(classes, labels)
    nodes = uniform_nodes(spark, classes * size)
    shared = (table[:, None, :] == table[None, :, :]) * (weights / np.maximum((table[:, None, :] == table[None, :, :]).sum(axis=1) * size - 1, 1))[:, None, :]
    found = [float(x) for x in shared.sum(axis=2).ravel()]
    # A class in parts of nodes that meet pieces of it, all of one length; that of a piece is whole bytes of a file, whatever the bits of a node.
    parts, pieces = max(-(-size // (PIECE * PART)), 1), max(-(-size // PIECE), 1)
    long, wide = max(-(-size // parts), 1), max(-(-size // (8 * pieces)) * 8, 1)
    numbers = classes * parts * pieces * classes * long * wide if size else 0
    rest = spark.range(0, numbers, 1, max(spark.sparkContext.defaultParallelism, -(-numbers // TASK)))
    # The class of dst changes from tile to tile, so that tasks have an even share of the classes that share nothing.
    for name, n in (("d", wide), ("s", long), ("b", classes), ("piece", pieces), ("part", parts)):
        rest = rest.withColumn(name, F.col("id") % n).withColumn("id", F.expr(f"id DIV {n}"))
    pairs = rest.withColumnRenamed("id", "a").withColumn("s", F.col("part") * long + F.col("s")).withColumn("d", F.col("piece") * wide + F.col("d"))
    kind = (F.col("a") * classes + F.col("b")).cast("int")
    pairs = pairs.where((F.col("s") < size) & (F.col("d") < size) & F.get(F.array(*[F.lit(x != 0) for x in found]), kind))
    pairs = pairs.select((F.col("a") * size + F.col("s")).alias("src"), (F.col("b") * size + F.col("d")).alias("dst"), F.get(F.array(*[weigh(F.lit(x)) for x in found]), kind).alias("w"))
    return nodes, pairs.where("src != dst")


def _blocks(spark: SparkSession, n: int, block: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("sample_id"), F.floor(F.col("id") / block).alias("k"))


def _adjacent(rows: DataFrame) -> DataFrame:
    after = rows.select(F.col("sample_id").alias("dst"), (F.col("k") - 1).alias("k"))
    forward = rows.join(after, "k").select(F.col("sample_id").alias("src"), "dst", F.lit(1.0).alias("w"))
    return forward.union(forward.select("dst", "src", "w"))


def serial(spark: SparkSession, n: int, block: int) -> tuple[DataFrame, DataFrame]:
    """All pairs of adjacent blocks, both ways, weight 1; node weights 1 in the first and last whole block, else 2. What is left after the whole blocks is a shorter one."""
    if n <= block:
        raise ValueError("a serial graph has two or more blocks")
    rows = _blocks(spark, n, block)
    nodes = rows.select("sample_id", F.when(F.col("k").isin(0, n // block - 1), 1.0).otherwise(2.0).alias("v"))
    return nodes, _adjacent(rows)


def mixed(spark: SparkSession, n: int, block: int) -> tuple[DataFrame, DataFrame]:
    """serial's edges, and all pairs within a block, loops too: weight 2 in the first and last block, else 1; node weights 2 * block."""
    rows = _blocks(spark, n, block)
    inner = rows.join(rows.select(F.col("sample_id").alias("dst"), "k"), "k")
    inner = inner.select(F.col("sample_id").alias("src"), "dst", F.when(F.col("k").isin(0, n // block - 1), 2.0).otherwise(1.0).alias("w"))
    return uniform_nodes(spark, n), add_up(_adjacent(rows), inner)


def improved(spark: SparkSession, n: int, block: int, balance: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """mixed without loops, the edges within blocks times balance."""
    nodes, _ = mixed(spark, n, block)
    rows = _blocks(spark, n, block)
    inner = rows.join(rows.select(F.col("sample_id").alias("dst"), "k"), "k").where("sample_id != dst")
    inner = inner.select(F.col("sample_id").alias("src"), "dst", (F.when(F.col("k").isin(0, n // block - 1), 2.0).otherwise(1.0) * balance).alias("w"))
    return nodes, add_up(_adjacent(rows), inner)


def sliding_window(spark: SparkSession, n: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Samples up to width apart, weight 1 / (2 width), doubled in the corners; loops make every sample's edges sum to 1.

    A corner is a pair of places, counted from 1, whose sum is at most width + 1 or at least 2 n - 1.
    """
    rows = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.greatest(F.col("id") - width, F.lit(0)), F.least(F.col("id") + width, F.lit(n - 1)))).alias("dst"))
    at = F.col("src") + F.col("dst") + 2
    corner = (at <= width + 1) | (at >= 2 * n - 1)
    edges = rows.where("src != dst").withColumn("w", F.when(corner, 2.0).otherwise(1.0) / (2 * width))
    loops = edges.groupBy("src").agg(F.sum("w").alias("s")).where(F.col("s") < 1 - 1e-12).select("src", F.col("src").alias("dst"), (1 - F.col("s")).alias("w"))
    return uniform_nodes(spark, n), edges.unionByName(loops)


#: Ties that add_unlabelled lists at most.
MOST_TIES = 100_000_000


def add_unlabelled(nodes: DataFrame, edges: DataFrame, new: DataFrame, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """new (sample_id) samples share so much of the labelled ones' weight, and are tied to all of them, both ways, evenly.

    Every labelled-unlabelled pair is an edge: for small graphs; with_unlabelled adds such samples to moments without the pairs.
    """
    q, n1 = nodes.agg(F.sum("v"), F.count("*")).first()
    n2 = new.count()
    if n1 * n2 > MOST_TIES:
        raise ValueError(f"{n1} x {n2} ties are over {MOST_TIES}; with_unlabelled needs none of them")
    v2 = q * share / max(n2, 1)
    ties = nodes.select(F.col("sample_id").alias("src")).join(F.broadcast(new.select(F.col("sample_id").alias("dst"))), F.lit(True)).withColumn("w", F.lit(v2 / max(n1, 1)))
    return nodes.unionByName(new.select("sample_id", F.lit(v2).alias("v"))), add_up(edges, ties, ties.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def consistency(nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-6, two_sided: bool = True) -> DataFrame:
    """(sample_id, node_share, out_share, in_share, consistent): a node's share of the weights, and its edges' share of theirs."""
    q, r = F.lit(nodes.agg(F.sum("v")).first()[0]), F.lit(edges.agg(F.sum("w")).first()[0])
    out = edges.groupBy(F.col("src").alias("_o")).agg(F.sum("w").alias("o"))
    into = edges.groupBy(F.col("dst").alias("_i")).agg(F.sum("w").alias("i"))
    rows = nodes.join(out, F.col("sample_id") == F.col("_o"), "left").join(into, F.col("sample_id") == F.col("_i"), "left")
    rows = rows.select("sample_id", (F.col("v") / q).alias("node_share"), (F.coalesce("o", F.lit(0.0)) / r).alias("out_share"), (F.coalesce("i", F.lit(0.0)) / r).alias("in_share"))
    off = lambda c: F.abs(F.col("node_share") - F.col(c)) if two_sided else F.col("node_share") - F.col(c)
    return rows.withColumn("consistent", (off("out_share") <= tolerance) & (off("in_share") <= tolerance))


def symmetric(edges: DataFrame) -> DataFrame:
    """Half of each edge in either direction."""
    half = scaled(edges, 0.5)
    return add_up(half, half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def normalised(nodes: DataFrame, edges: DataFrame, back: bool = False) -> DataFrame:
    """w / sqrt(v_src v_dst) of each edge, or with back the other way."""
    a = nodes.select(F.col("sample_id").alias("src"), F.col("v").alias("va"))
    b = nodes.select(F.col("sample_id").alias("dst"), F.col("v").alias("vb"))
    root = F.sqrt(F.col("va") * F.col("vb"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (F.col("w") * root if back else F.col("w") / root).alias("w"))


def graph_deltas(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, delta): sum of w (y_j - y_i)^2 over sum of w, for each component of values (sample_id, features)."""
    a = values.select(F.col("sample_id").alias("src"), F.col("features").alias("a"))
    b = values.select(F.col("sample_id").alias("dst"), F.col("features").alias("b"))
    rows = edges.join(a, "src").join(b, "dst").select("w", F.posexplode(F.zip_with("a", "b", lambda p, q: (q - p) * (q - p))).alias("i", "d"))
    return rows.groupBy("i").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("delta"))


def without_negative_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An equivalent graph: c v_i v_j is added to every pair, loops too, with the least c that leaves no weight below 0, and all divided by 1 + c Q^2 / R.

    No negative weight: the edges as they are. The result is dense.
    """
    a = nodes.select(F.col("sample_id").alias("src"), F.col("v").alias("va"))
    b = nodes.select(F.col("sample_id").alias("dst"), F.col("v").alias("vb"))
    least = edges.join(a, "src").join(b, "dst").agg(F.min(F.col("w") / (F.col("va") * F.col("vb")))).first()[0]
    if least is None or least >= 0:
        return edges
    q, r = nodes.agg(F.sum("v")).first()[0], edges.agg(F.sum("w")).first()[0]
    pairs = a.join(F.broadcast(b) if nodes.count() <= 100_000 else b, F.lit(True)).select("src", "dst", (-least * F.col("va") * F.col("vb")).alias("w"))
    return scaled(add_up(edges, pairs), 1 / (1 - least * q * q / r))


def free_responses(samples: DataFrame, labels: list[Column], weight: Column) -> DataFrame:
    """samples with free ARRAY<DOUBLE>: 1 and the labels, each scaled to weighted mean square 1 and freed of the ones before it.

    A few numbers a label are gathered: the Gram matrix of [1, labels].
    """
    rows = samples.withColumn("_l", F.array(F.lit(1.0), *[x.cast("double") for x in labels])).withColumn("_v", weight)
    n = len(labels) + 1
    cells = [F.sum(F.col("_v") * F.get("_l", i) * F.get("_l", j)).alias(f"g{i}_{j}") for i in range(n) for j in range(n)]
    got = rows.agg(F.sum("_v").alias("q"), *cells).first()
    gram = np.array([[got[f"g{i}_{j}"] for j in range(n)] for i in range(n)]) / got["q"]
    change = np.linalg.inv(np.linalg.cholesky(gram))  # Gram-Schmidt: rows combine [1, labels]
    made = F.array(*[sum((F.lit(float(change[j, i])) * F.get("_l", i) for i in range(j + 1)), F.lit(0.0)) for j in range(n)])
    return rows.withColumn("free", made).drop("_l", "_v")


def label_moments(samples: DataFrame, size: int, deltas: list[float]) -> Moments:
    """Moments of the graph whose free responses are those of samples (features, v, free), with the given deltas after the constant's 0.

    Its edges w_ij = sum over j of (2 - delta_j) / 2 * v_i v_j f_i f_j / Q are
    never made: x' W x is a sum over responses of (sum v f x) squared.
    """
    n = len(deltas) + 1

    def add(s: Moments, b) -> None:
        from driftline.operators.moments import matrix

        x, v = matrix(b), b.column("v").to_numpy(zero_copy_only=False)
        s.nodes(x, v)

    state = merge(partial(samples.select("features", "v"), add, size), size)
    sums = samples.select("v", "free", F.posexplode("features").alias("i", "x")).groupBy("i").agg(*[F.sum(F.col("v") * F.get("free", j) * F.col("x")).alias(f"b{j}") for j in range(n)]).collect()
    b = np.zeros((size, n))
    for r in sums:
        b[r["i"]] = [r[f"b{j}"] for j in range(n)]
    weights = np.array([1.0, *[(2 - d) / 2 for d in deltas]]) / state.q
    state.r = state.q
    state.sdd = 2 * state.sxx - 2 * (b * weights) @ b.T
    return state


def eigenvectors(nodes: DataFrame, edges: DataFrame, least: int = 10_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and vectors of the normalised symmetric graph, and the ids of their rows. Graphs over the given size raise."""
    ids = [r[0] for r in nodes.select("sample_id").orderBy("sample_id").limit(least + 1).collect()]
    if len(ids) > least:
        raise ValueError(f"graphs of over {least} nodes are not solved densely")
    names = np.array(ids, np.int64)
    m = np.zeros((len(ids), len(ids)))
    found = normalised(nodes, symmetric(edges)).select("src", "dst", "w").toArrow()
    src, dst, w = (found.column(c).to_numpy() for c in ("src", "dst", "w"))
    np.add.at(m, (np.searchsorted(names, src), np.searchsorted(names, dst)), w)
    values, vectors = np.linalg.eigh(m)
    vectors = vectors * np.where(vectors[:1] > 0, -1, 1)
    return values[::-1], vectors[:, ::-1], names


def deltas_of(eigenvalues: np.ndarray, q: float, r: float) -> np.ndarray:
    return 2 - 2 * eigenvalues * q / r


def auxiliary_labels(label: Column, low: float, high: float, count: int) -> list[Column]:
    """Cosines of the rescaled label at harmonics 2 and on."""
    share = (label - low) / (high - low)
    return [F.cos(np.pi * k * share) for k in range(2, 2 + count)]
