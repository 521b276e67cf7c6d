"""The leading free responses of large graphs: eigenvectors of the normalised graph, found without its matrix.

A block of vectors is a table with an array for each node; the graph acts on it
by one join with the edges and sums by node. Chebyshev polynomials of the
graph damp what is not wanted, and a Rayleigh-Ritz step, which only needs the
Gram matrix of the block and its image, tells eigenvalues and residuals. What
reaches the driver are matrices of the block's width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.estimators import map_vectors, numbers
from driftline.operators.graphs import deltas_of, normalised, symmetric
from driftline.operators.moments import matrix, merge, unlabelled, with_ord
from driftline.session import ship
from driftline.staging import settled

#: Products with the graph in a filter, and after how many of them the block is written.
DEGREE, WRITTEN = 20, 10
#: Edges that may be broadcast (some 50 bytes each); more are joined by a shuffle.
BROADCAST_EDGES = 500_000
#: Graphs of at most so many edges and nodes are worked on as arrays of the driver (some 50 MB).
LOCAL_EDGES = 500_000


@dataclass(frozen=True)
class Responses:
    """table: (sample_id, response ARRAY<DOUBLE>), the slowest response first; values: eigenvalues; deltas; residuals: how far each is from an eigenvector."""

    table: DataFrame
    values: np.ndarray
    deltas: np.ndarray
    residuals: np.ndarray


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).reshape(-1)))


def _added(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id once, and the sum of its rows."""
    names, which = np.unique(ids, return_inverse=True)
    total = np.zeros((len(names), x.shape[1]))
    np.add.at(total, which, x)
    return names, total


def product(vectors: DataFrame, edges: DataFrame, size: int, factor: float = 1.0, own: float = 0.0, before: float = 0.0) -> DataFrame:
    """(sample_id, x, past): factor times the graph's product with x, own times x and before times past; past is x. Every node of vectors (sample_id, x, past) stays.

    What a task sends to a node is one row for each of its batches, so a node of very many edges is no hot one.
    """
    ship(vectors.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names, total = _added(batch.column("dst").to_numpy(), matrix(batch, "x") * batch.column("w").to_numpy()[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(names), _lists(total), pa.nulls(len(names), pa.list_(pa.float64()))], ["sample_id", "x", "past"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sent, nodes, now, past = [], [np.zeros((0, size))], [], [np.zeros((0, size))], [np.zeros((0, size))]
        for batch in batches:
            is_node = pc.is_valid(batch.column("past"))
            mine, others = batch.filter(is_node), batch.filter(pc.invert(is_node))
            if mine.num_rows:
                nodes.append(mine.column("sample_id").to_numpy())
                now.append(matrix(mine, "x"))
                past.append(matrix(mine, "past"))
            if others.num_rows:
                ids.append(others.column("sample_id").to_numpy())
                sent.append(matrix(others, "x"))
        if nodes:
            nodes, now, past = np.concatenate(nodes), np.concatenate(now), np.concatenate(past)
            out = own * now + before * past
            if ids:
                names, total = _added(np.concatenate(ids), np.concatenate(sent))
                order = np.argsort(nodes)
                at = np.minimum(np.searchsorted(nodes[order], names), len(nodes) - 1)
                there = nodes[order][at] == names
                out[order[at[there]]] += factor * total[there]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), _lists(out), _lists(now)], ["sample_id", "x", "past"])

    schema = "sample_id long, x array<double>, past array<double>"
    sent = edges.join(vectors.select(F.col("sample_id").alias("src"), "x"), "src").select("dst", "w", "x").mapInArrow(send, schema)
    rows = sent.union(vectors.select(F.col("sample_id").cast("long").alias("sample_id"), "x", "past"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(parts, "sample_id").mapInArrow(meet, schema)


def _steps(low: float, cut: float, top: float) -> list[tuple[float, float, float]]:
    """The factors of the graph's product, of the block and of the block before in each step of a scaled Chebyshev polynomial, small between low and cut and large from there to top."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    first = sigma = half / (top - middle)
    out = [(sigma / half, -middle * sigma / half, 0.0)]
    for _ in range(DEGREE - 1):
        step = 1 / (2 / first - sigma)
        out.append((2 * step / half, -2 * middle * step / half, -sigma * step))
        sigma = step
    return out


def _drawn(first: int, last: int, seed: int) -> list:
    """Numbers from -1 to 1 by hashes of sample_id, for the columns from first to last."""
    return [F.xxhash64("sample_id", F.lit(seed), F.lit(k)) / float(2**63) for k in range(first, last)]


class _Tables:
    """The block as a table; graph (src, dst, w) and roots (sample_id, s) are tables too."""

    def __init__(self, graph: DataFrame, roots: DataFrame, size: int, seed: int) -> None:
        self.graph, self.roots, self.size = F.broadcast(graph) if graph.count() <= BROADCAST_EDGES else graph, roots, size
        drawn = F.array(*_drawn(0, size, seed))
        self.block = settled(roots.select("sample_id", drawn.alias("x"), drawn.alias("past")))

    def gram(self) -> np.ndarray:
        """Of the block, its image and the constant."""
        image = product(self.block, self.graph, self.size)
        self.joint = settled(image.join(self.roots, "sample_id").select("sample_id", F.concat("past", "x", F.array("s")).alias("features")))
        n = 2 * self.size + 1
        return merge(unlabelled(self.joint, n), n).sxx

    def turn(self, change: np.ndarray) -> None:
        """The block becomes what change makes of the block, its image and the constant."""
        made = map_vectors(self.joint, lambda x: x @ change, "features", "x").select("sample_id", "x")
        self.block = made.withColumn("past", F.col("x"))

    def redraw(self, first: int, seed: int) -> None:
        kept = [F.get("x", k) for k in range(first)]
        made = self.block.select("sample_id", F.array(*kept, *_drawn(first, self.size, seed)).alias("x"))
        self.block = made.withColumn("past", F.col("x"))

    def filter(self, steps: list[tuple[float, float, float]]) -> None:
        now = self.block
        for k, (factor, own, before) in enumerate(steps, 1):
            now = product(now, self.graph, self.size, factor, own, before)
            if k % WRITTEN == 0 and k < len(steps):
                now = settled(now)
        self.block = settled(now.select("sample_id", "x", F.col("x").alias("past")))

    def table(self) -> DataFrame:
        return self.block.select("sample_id", "x")


class _Arrays:
    """The same for a graph of at most LOCAL_EDGES edges and nodes, as arrays of the driver."""

    def __init__(self, graph: DataFrame, roots: DataFrame, size: int, seed: int) -> None:
        self.spark, self.size = roots.sparkSession, size
        drawn = [c.alias(f"x{k}") for k, c in enumerate(_drawn(0, size, seed))]
        held = roots.select(F.col("sample_id").cast("long").alias("sample_id"), "s", *drawn).toArrow()
        ids = held.column("sample_id").to_numpy()
        order = np.argsort(ids)
        self.ids, self.s = ids[order], held.column("s").to_numpy()[order]
        self.x = np.stack([held.column(f"x{k}").to_numpy()[order] for k in range(size)], axis=1)
        edges = graph.toArrow()
        src, dst = (np.searchsorted(self.ids, edges.column(c).to_numpy()) for c in ("src", "dst"))
        by = np.argsort(dst, kind="stable")
        self.src, self.w = src[by], edges.column("w").to_numpy()[by]
        self.rows, self.starts = np.unique(dst[by], return_index=True)

    def product(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        if len(self.rows):
            out[self.rows] = np.add.reduceat(x[self.src] * self.w[:, None], self.starts, axis=0)
        return out

    def gram(self) -> np.ndarray:
        self.joint = np.concatenate([self.x, self.product(self.x), self.s[:, None]], axis=1)
        return self.joint.T @ self.joint

    def turn(self, change: np.ndarray) -> None:
        self.x = self.joint @ change

    def redraw(self, first: int, seed: int) -> None:
        self.x[:, first:] = np.random.default_rng(seed).uniform(-1, 1, (len(self.x), self.size - first))

    def filter(self, steps: list[tuple[float, float, float]]) -> None:
        now, past = self.x, np.zeros_like(self.x)
        for factor, own, before in steps:
            now, past = factor * self.product(now) + own * now + before * past, now
        self.x = now

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(pa.table({"sample_id": self.ids, "x": _lists(self.x)}))


def leading_responses(nodes: DataFrame, edges: DataFrame, count: int, *, constant: bool = True, tolerance: float = 1e-5, extra: int | None = None, rounds: int = 100, seed: int = 0) -> Responses:
    """The count slowest free responses of a graph: nodes (sample_id, v > 0), edges (src, dst, w).

    With constant the first one is 1 for every node, which is the slowest of
    a consistent graph (another one raises), and the others have weighted mean
    0. Each has weighted mean square 1 and is not positive at the node of the
    least id. A residual over tolerance (of the largest sum of a node's weights)
    after all rounds raises, as does a graph of fewer nodes than responses.
    """
    n, q, least = nodes.agg(F.count("*"), F.sum("v"), F.min("sample_id")).first()
    if not n or n < count:
        raise ValueError(f"a graph of {n} nodes does not have {count} responses")
    r = edges.agg(F.sum("w")).first()[0]
    roots = nodes.select("sample_id", F.sqrt(F.col("v") / q).alias("s"))
    wanted = count - int(constant)
    size = min(wanted + (extra if extra is not None else max(8, wanted)), n - int(constant))
    graph = settled(normalised(nodes, symmetric(edges)).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "w"))
    # No eigenvalue is larger than the largest row sum of W / v; the constant is one's vector if the row sums are those of v, times R / Q.
    sums = symmetric(edges).groupBy(F.col("src").alias("sample_id")).agg(F.sum(F.abs("w")).alias("a"), F.sum("w").alias("b"))
    told = nodes.join(sums, "sample_id", "left").agg(F.max(F.col("a") / F.col("v")), F.max(F.abs(F.coalesce("b", F.lit(0.0)) / F.col("v") - float(r or 0.0) / float(q)))).first()
    bound = float(told[0] or 0.0) or 1.0
    if constant and told[1] > 1e-6 * bound:
        raise ValueError("the graph is not consistent, so the constant is no response of it; see with_constant")
    values = residuals = np.zeros(0)
    few = graph.count() <= LOCAL_EDGES and n <= LOCAL_EDGES
    block = (_Arrays if few else _Tables)(graph, roots, max(size, 1), seed)
    for turn in range(rounds if wanted else 0):
        gram = block.gram()
        along = gram[: 2 * size, -1] if constant else np.zeros(2 * size)  # what the block and its image have of the constant
        clean = gram[: 2 * size, : 2 * size] - np.outer(along, along)
        own, cross, far = clean[:size, :size], clean[:size, size:], clean[size:, size:]
        scale, turned = np.linalg.eigh(own)
        good = scale > 1e-13 * scale[-1]
        white = turned[:, good] / np.sqrt(scale[good])
        theta, inner = np.linalg.eigh(white.T @ (cross + cross.T) @ white / 2)
        order = np.argsort(-theta)
        theta, change = theta[order], white @ inner[:, order]
        residuals = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", change, far, change) - theta**2, 0.0))
        values = theta
        full = np.zeros((2 * size + 1, size))
        full[:size, : change.shape[1]] = change
        full[-1, : change.shape[1]] = -along[:size] @ change
        block.turn(full)
        if len(theta) >= wanted and (residuals[:wanted] <= tolerance * bound).all():
            break
        if len(theta) < size:  # directions that vanished are drawn anew
            block.redraw(len(theta), seed + turn + 1)
        cut = float(theta[-1]) if len(theta) > wanted and theta[-1] < theta[wanted - 1] else float(theta[min(wanted, len(theta)) - 1]) - 1e-3 * bound
        cut = max(cut, -bound * 0.999)
        block.filter(_steps(-bound * (1 + 1e-9), cut, max(float(theta[0]), cut + 1e-3 * bound)))
    else:
        if wanted:
            raise ValueError(f"residuals of up to {residuals[:wanted].max(initial=0):.2g} after {rounds} rounds")
    block = block.table()
    response = F.transform(F.slice("x", 1, max(wanted, 1)), lambda e: e / F.col("s")) if wanted else F.array().cast("array<double>")
    found = block.join(roots, "sample_id").select("sample_id", response.alias("response"))
    if constant:
        found = found.select("sample_id", F.concat(F.array(F.lit(1.0)), "response").alias("response"))
        first = float(r) / float(q) if r else 0.0
        values, residuals = np.concatenate([[first], values[:wanted]]), np.concatenate([[0.0], residuals[:wanted]])
    found = settled(found)
    start = np.array(found.where(F.col("sample_id") == least).first()["response"])
    signs = np.where((start > 0) & (np.arange(count) >= int(constant)), -1.0, 1.0)
    table = found.select("sample_id", F.zip_with("response", numbers(signs), lambda a, b: a * b).alias("response"))
    return Responses(table, values[:count], deltas_of(values[:count], float(q), float(r)), residuals[:count])


def _chain_values(diagonal: np.ndarray, beside: np.ndarray, low: int, high: int) -> np.ndarray:
    """Eigenvalues low to high - 1, falling, of the symmetric matrix with these numbers on and beside its diagonal: by bisection, with counts of those below."""
    size, rank = len(diagonal), np.arange(low, high)
    reach = np.abs(diagonal)
    reach[:-1] += np.abs(beside)
    reach[1:] += np.abs(beside)
    bound = float(reach.max(initial=0.0)) * (1 + 1e-12) + 1e-300
    bottom, top = np.full(len(rank), -bound), np.full(len(rank), bound)
    square = np.concatenate([[0.0], beside * beside])
    for _ in range(56):
        middle = (bottom + top) / 2
        below, past = np.zeros(len(rank), np.int64), np.ones(len(rank))
        for a, b in zip(diagonal.tolist(), square.tolist(), strict=True):
            past = a - middle - b / past
            past[np.abs(past) < 1e-280] = -1e-280
            below += past < 0
        over = size - below > rank  # so many lie at the middle or above
        bottom, top = np.where(over, middle, bottom), np.where(over, top, middle)
    return (bottom + top) / 2


#: Eigenvalues that a task finds at most.
VALUES = 512


def chain_spectrum(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(k, value): all eigenvalues of the normalised graph, falling, of a graph whose nodes fall into a chain of classes.

    Nodes of one weight with the same edges are one class: they have as many
    eigenvalues 0 as there are nodes less one. In the order of its least node,
    a class may have edges to itself, the one before and the next; another
    graph raises. Two numbers a class reach the driver and go to every task,
    which finds its share of the eigenvalues by bisection.
    """
    spark = nodes.sparkSession
    ship(spark)
    graph = symmetric(edges)
    hashes = [F.sum(F.xxhash64("dst", "w", F.lit(seed)).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (0, 1)]
    told = nodes.join(graph.groupBy(F.col("src").alias("_n")).agg(*hashes), F.col("sample_id") == F.col("_n"), "left")
    classes = told.groupBy("v", "h0", "h1", F.when(F.col("h0").isNull(), F.col("sample_id")).alias("_own")).agg(F.min("sample_id").alias("least"), F.count("*").alias("n")).select("least", "n", "v")
    classes = settled(with_ord(classes, F.col("least")))
    at = lambda name: classes.select(F.col("least").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("ord", "n", "v")])
    # One node of a class has the edges of all; what they lead to are the nodes of a class.
    held = graph.join(at("src"), "src").join(at("dst"), "dst")
    scaled = F.col("w") * F.sqrt(F.col("src_n") * F.col("dst_n") / (F.col("src_v") * F.col("dst_v")))
    held = held.select(F.col("src_ord").alias("i"), F.col("dst_ord").alias("j"), scaled.alias("x")).toArrow()
    size = classes.count()
    i, j, x = (held.column(c).to_numpy() for c in ("i", "j", "x"))
    if (np.abs(i - j) > 1).any():
        raise ValueError("the classes of the graph are no chain")
    diagonal, beside = np.zeros(size), np.zeros(max(size - 1, 0))
    diagonal[i[i == j]] = x[i == j]
    beside[i[j == i + 1]] = x[j == i + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in (batch.column("id").to_numpy() * VALUES).tolist():
                high = min(size, start + VALUES)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, high)), pa.array(_chain_values(diagonal, beside, start, high))], ["k", "value"])

    shares = -(-size // VALUES)
    found = settled(spark.range(0, shares, 1, shares).mapInArrow(run, "k long, value double"))
    more = nodes.count() - size
    over = found.where("value > 0").count()
    zeros = spark.range(more).select((F.col("id") + over).alias("k"), F.lit(0.0).alias("value"))
    return found.select((F.col("k") + F.when(F.col("value") > 0, 0).otherwise(more)).alias("k"), "value").union(zeros)


def eigenvectors_of(responses: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sample_id, vector): responses times sqrt(v / Q), which have norm 1."""
    q = nodes.agg(F.sum("v")).first()[0]
    scaled = responses.join(nodes.select("sample_id", F.sqrt(F.col("v") / q).alias("_s")), "sample_id")
    return scaled.select("sample_id", F.transform("response", lambda y: y * F.col("_s")).alias("vector"))


def responses_of(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sample_id, response): eigenvectors (sample_id, vector) times sqrt(Q / v), the other way."""
    q = nodes.agg(F.sum("v")).first()[0]
    scaled = vectors.join(nodes.select("sample_id", F.sqrt(F.lit(q) / F.col("v")).alias("_s")), "sample_id")
    return scaled.select("sample_id", F.transform("vector", lambda y: y * F.col("_s")).alias("response"))


def with_constant(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sample_id, vector): the constant's eigenvector first, then vectors (sample_id, vector) less what they have of it, made orthonormal one after another; one that vanishes is left out."""
    size = vectors.select(F.max(F.size("vector"))).first()[0] or 0
    q = nodes.agg(F.sum("v")).first()[0]
    joint = vectors.join(nodes.select("sample_id", F.sqrt(F.col("v") / q).alias("_s")), "sample_id").select("sample_id", F.concat(F.array("_s"), "vector").alias("features"))
    gram = merge(unlabelled(joint, size + 1), size + 1).sxx
    change = []
    for k in range(size + 1):
        e = np.eye(size + 1)[k]
        for _ in range(2):  # twice is enough
            for c in change:
                e = e - c * (c @ gram @ e)
        norm = e @ gram @ e
        if norm > 1e-12 * max(gram[k, k], 1e-300):
            change.append(e / np.sqrt(norm))
    matrix = np.stack(change, axis=1)
    return map_vectors(joint, lambda x: x @ matrix, "features", "vector").select("sample_id", "vector")
