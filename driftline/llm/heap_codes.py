"""Operator 13: product codes of vectors, learnt by Lloyd's rounds with heaps.

Vectors become integers and are cut into parts; each part position has its
own codebook. After one full search a part only remembers how much nearer its
entry was than the second best: the difference of the two distances (its
slack), which the entries' movements eat up. Every entry has a heap of its
parts in each block of vectors, keyed by slack plus the movement that the
entry's parts had seen when they were put in; a round adds the entry's own
movement and the largest one of the others to the entry's count, and pops
only the parts whose keys that count has reached. Popped parts are compared
with all entries in exact integers; all others keep their entry for certain.

A block is the vectors of one Arrow batch of a task, with its heaps, as one row
of a staged table that each round writes anew; a lost executor repeats its
blocks of one round. Only parts that changed their entry move sums: tasks add
them up before a groupBy does.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import BROADCAST_IDS, giving_back, read_table, small_batches, stage, unstage
from driftline.llm.lloyd import digest, vectors

PARTS, ENTRIES, ROUNDS, GRAIN = 4, 256, 4, 1024
#: Integer components of a larger size raise: the distances of vectors of up to 2**12 components fit 64 bits.
LARGEST = 1 << 24
#: Slacks are floating-point numbers; a part is searched anew if its key is within this of the bound.
MARGIN = 1e-6


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all entries, exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # every sum is a whole number that a double holds
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for k, c in enumerate(entries.astype(np.int64)):
        away = x - c
        out[:, k] = (away * away).sum(axis=1)
    return out


def search(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest number of the nearest entries, and how much farther the next one is, of each row."""
    d = distances(x, entries)
    at = np.arange(len(x))
    best = d.argmin(axis=1)
    near = np.sqrt(d[at, best].astype(float))
    if len(entries) == 1:
        return best, np.full(len(x), np.inf)
    d[at, best] = np.iinfo(np.int64).max
    return best, np.sqrt(d.min(axis=1).astype(float)) - near


class Heaps:
    """The heaps of one part position in a block: the places of the block's vectors under each entry, the least key first."""

    def __init__(self, entries: int, keys: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> None:
        self.keys, self.places, self.starts = keys, places, np.concatenate([[0], np.cumsum(sizes)])
        self.open: dict[int, list[tuple[float, int]]] = {}
        self.entries = entries

    @staticmethod
    def of(best: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        """Heaps of all places by entry; a sorted array is a heap."""
        order = np.lexsort((keys, best))
        return Heaps(entries, keys[order], order, np.bincount(best, minlength=entries))

    def heap(self, entry: int) -> list[tuple[float, int]]:
        if entry not in self.open:
            a, b = self.starts[entry : entry + 2]
            self.open[entry] = list(zip(self.keys[a:b].tolist(), self.places[a:b].tolist(), strict=True))
        return self.open[entry]

    def pop(self, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes out the places whose keys are reached; they, and the entries they were under."""
        full = np.flatnonzero(np.diff(self.starts))
        tops = self.keys[self.starts[full]]
        places, entries = [], []
        for entry in full[tops <= reached[full]].tolist():
            heap, bound = self.heap(entry), reached[entry]
            while heap and heap[0][0] <= bound:
                places.append(heapq.heappop(heap)[1])
                entries.append(entry)
        return np.array(places, np.int64), np.array(entries, np.int64)

    def push(self, best: np.ndarray, keys: np.ndarray, places: np.ndarray) -> None:
        for entry, key, place in zip(best.tolist(), keys.tolist(), places.tolist(), strict=True):
            heapq.heappush(self.heap(entry), (key, place))

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and places, heap by heap, and the heaps' sizes."""
        if not self.open:
            return self.keys, self.places, np.diff(self.starts)
        cells = [(self.keys[a:b], self.places[a:b]) for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]
        for entry, heap in self.open.items():
            cells[entry] = np.array([k for k, _ in heap], float), np.array([p for _, p in heap], np.int64)
        return np.concatenate([k for k, _ in cells]), np.concatenate([p for _, p in cells]), np.array([len(k) for k, _ in cells])

    def assigned(self) -> np.ndarray:
        """The entry of each place."""
        _, places, sizes = self.flat()
        out = np.empty(len(places), np.int64)
        out[places] = np.repeat(np.arange(self.entries), sizes)
        return out


@dataclass(frozen=True)
class Codebooks:
    """entries: (part, entry, component); reached: by how much each entry's parts may have lost of their slack since the first search."""

    entries: np.ndarray
    reached: np.ndarray

    def moved_to(self, entries: np.ndarray) -> Codebooks:
        step = np.sqrt(((entries - self.entries).astype(float) ** 2).sum(axis=2))
        order = np.sort(step, axis=1)
        others = np.where(step == order[:, -1:], order[:, -2:-1] if step.shape[1] > 1 else 0.0, order[:, -1:])
        ties = (step == order[:, -1:]).sum(axis=1, keepdims=True) > 1
        others = np.where(ties, order[:, -1:], others)
        return Codebooks(entries, self.reached + step + others)


class Moves:
    """Sums that parts bring to an entry, less those they take from another."""

    def __init__(self, shape: tuple[int, int, int]) -> None:
        self.n, self.total = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)

    def add(self, part: int, entries: np.ndarray, x: np.ndarray, sign: int = 1) -> None:
        self.n[part] += sign * np.bincount(entries, minlength=self.n.shape[1])
        np.add.at(self.total[part], entries, sign * x)

    def rows(self) -> tuple[list[int], list[int], list[int], list[list[int]]]:
        part, entry = np.nonzero((self.n != 0) | (self.total != 0).any(axis=2))
        return part.tolist(), entry.tolist(), self.n[part, entry].tolist(), self.total[part, entry].tolist()


def update(x: np.ndarray, heaps: list[Heaps], books: Codebooks, moves: Moves | None) -> int:
    """Brings a block's heaps to the moved codebooks; the number of parts that were searched anew."""
    width = books.entries.shape[2]
    searched = 0
    for part, h in enumerate(heaps):
        places, old = h.pop(books.reached[part] + MARGIN)
        if not len(places):
            continue
        searched += len(places)
        mine = x[places, part * width : (part + 1) * width]
        best, slack = search(mine, books.entries[part])
        h.push(best, slack + books.reached[part][best], places)
        if moves is not None:
            away = best != old
            moves.add(part, old[away], mine[away], -1)
            moves.add(part, best[away], mine[away])
    return searched


_STATE = "data binary, keys binary, places binary, sizes binary, searched long, part int, entry int, n long, total array<long>"


def _lists(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class _Blocks:
    """A block table's rows: blocks, and in other rows the moves of a task."""

    def __init__(self, rows: DataFrame) -> None:
        self.kinds = {c: rows.schema[c].dataType for c in ("vec_id", "label")}
        self.schema = f"ids array<{self.kinds['vec_id'].simpleString()}>, labels array<{self.kinds['label'].simpleString()}>, {_STATE}"
        self.names = ["ids", "labels", "data", "keys", "places", "sizes", "searched", "part", "entry", "n", "total"]

    def block(self, ids: pa.Array, labels: pa.Array, x: np.ndarray, heaps: list[Heaps], searched: int) -> pa.RecordBatch:
        flat = [h.flat() for h in heaps]
        cells = [np.concatenate([f[k] for f in flat]).astype(t).tobytes() for k, t in enumerate((np.float64, np.int32, np.int32))]
        none = [pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([_lists(ids), _lists(labels), *[pa.array([b], pa.binary()) for b in (x.astype(np.int32).tobytes(), *cells)], pa.array([searched]), *none], self.names)

    def moves(self, made: Moves, ids: pa.DataType, labels: pa.DataType) -> pa.RecordBatch:
        part, entry, n, total = made.rows()
        none = [pa.nulls(len(part), t) for t in (pa.list_(ids), pa.list_(labels), *[pa.binary()] * 4, pa.int64())]
        return pa.RecordBatch.from_arrays([*none, pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), pa.array(total, pa.list_(pa.int64()))], self.names)


def _opened(batch: pa.RecordBatch, row: int, parts: int, entries: int) -> tuple[pa.Array, pa.Array, np.ndarray, list[Heaps]]:
    ids, labels = batch.column("ids")[row].values, batch.column("labels")[row].values
    x = np.frombuffer(batch.column("data")[row].as_py(), np.int32).reshape(len(ids), -1).astype(np.int64)
    keys, places, sizes = (np.frombuffer(batch.column(c)[row].as_py(), t).reshape(parts, -1) for c, t in (("keys", np.float64), ("places", np.int32), ("sizes", np.int32)))
    return ids, labels, x, [Heaps(entries, keys[p], places[p].astype(np.int64), sizes[p]) for p in range(parts)]


def _first_round(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Blocks of rows (vec_id, label, v), every part searched, and the sums of all."""
    form = _Blocks(rows)
    shape = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, kinds = Moves(shape), None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
                heaps = []
                for part in range(shape[0]):
                    mine = x[:, part * shape[2] : (part + 1) * shape[2]]
                    best, slack = search(mine, books.entries[part])
                    moves.add(part, best, mine)
                    heaps.append(Heaps.of(best, slack, shape[1]))
                kinds = batch.schema.field("vec_id").type, batch.schema.field("label").type
                yield form.block(batch.column("vec_id"), batch.column("label"), x, heaps, len(x) * shape[0])
        if kinds:
            yield form.moves(moves, *kinds)

    return rows.select("vec_id", "label", "v").mapInArrow(giving_back(run), form.schema)


def _next_round(blocks: DataFrame, form: _Blocks, books: Codebooks) -> DataFrame:
    shape = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, kinds = Moves(shape), None
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels, x, heaps = _opened(batch, row, shape[0], shape[1])
                searched = update(x, heaps, books, moves)
                kinds = ids.type, labels.type
                yield form.block(ids, labels, x, heaps, searched)
        if kinds:
            yield form.moves(moves, *kinds)

    return blocks.where("ids is not null").mapInArrow(giving_back(run), form.schema)


def _codes(blocks: DataFrame, form: _Blocks, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of every vector of the blocks, brought to the last codebooks."""
    shape = books.entries.shape
    hexed = np.array([f"{k:02x}" for k in range(shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels, x, heaps = _opened(batch, row, shape[0], shape[1])
                update(x, heaps, books, None)
                found = np.stack([h.assigned() for h in heaps], axis=1)
                away = x.reshape(len(x), shape[0], shape[2]) - books.entries[np.arange(shape[0]), found]
                error = (away * away).sum(axis=(1, 2))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(["".join(c) for c in hexed[found]], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = ", ".join(f"{c} {t.simpleString()}" for c, t in form.kinds.items())
    return blocks.where("ids is not null").mapInArrow(giving_back(run), f"{kinds}, code string, error long")


def _add_moves(blocks: DataFrame, n: np.ndarray, total: np.ndarray) -> None:
    """Adds the moves of all tasks to the sums of the entries: a row for each entry reaches the driver."""
    wide = [F.sum(F.get("total", i).cast("decimal(20,0)")).alias(f"t{i}") for i in range(total.shape[2])]
    for r in blocks.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():
        n[r["part"], r["entry"]] += r["n"]
        total[r["part"], r["entry"]] += np.array([int(r[f"t{i}"]) for i in range(total.shape[2])], object)


def learn(rows: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame, _Blocks, list[int]]:
    """The codebooks after some rounds from the first ones, the blocks of rows (vec_id, label, v) as the last round left them, their form, and the parts each round searched anew."""
    books = Codebooks(first, np.zeros(first.shape[:2]))
    form = _Blocks(rows)
    n, total = np.zeros(first.shape[:2], object), np.zeros(first.shape, object)
    blocks, searched = None, []
    for _ in range(rounds):
        before, blocks = blocks, stage(_first_round(rows, books) if blocks is None else _next_round(blocks, form, books), "blocks")
        if before is not None:
            unstage(before)
        _add_moves(blocks, n, total)
        searched.append(blocks.agg(F.sum("searched")).first()[0] or 0)
        entries = books.entries.copy()
        used = n > 0
        entries[used] = (total[used] // n[used][:, None]).astype(np.int64)
        books = books.moved_to(entries)
    return books, blocks, form, searched


def vector_codes(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, grain: int = GRAIN) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row of table (vec_id, embedding, label; other columns are ignored) with a finite vector.

    Rows whose vector is null or holds a null or a number that is not finite
    do not come out. All vectors should have one length, a multiple of parts:
    that of the row of the smallest vec_id with such a length; rows of another
    one have a null code and error and take no part. Repeated rows count as
    often as they stand; equal vec_ids start entries in the order of their
    vectors, and rows without a vec_id come after all others. Fewer vectors
    than entries make smaller codebooks. label_error adds up the errors of
    equal labels, nulls together. An empty table gives no rows. Ties go to
    the lowest entry; components of over 2**24 / grain raise.
    """
    spark = table.sparkSession
    small_batches(spark)
    kept = stage(vectors(table, None, grain, "label", largest=LARGEST), "vectors")
    able = kept.where(f"size(v) > 0 and size(v) % {parts} = 0")
    start = able.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v")).first()
    kinds = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    nothing = spark.createDataFrame([], f"{kinds}, code string, error long")
    if start is None:
        coded, others, name = nothing, kept, digest(np.zeros(0, np.int64))
    else:
        size = start[0]
        rows, others = kept.where(F.size("v") == size), kept.where(F.size("v") != size)
        first = np.array([r["v"] for r in rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()], np.int64)
        first = first.reshape(len(first), parts, size // parts).transpose(1, 0, 2)
        books, blocks, form, _ = learn(rows, first, rounds)
        coded, name = _codes(blocks, form, books), digest(books.entries)
    found = stage(coded.unionByName(others.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))), "codes")
    unstage(kept)
    if start is not None:
        unstage(blocks)
    sums = found.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("long").alias("label_error"))
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_IDS else sums
    return found.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read_table(spark, sf_dir, "embeddings"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, grain: int = GRAIN) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS (SELECT vec_id, label, p, v, min(d) AS d, arg_min(e, (d, e)) AS e FROM "
            f"(SELECT x.*, c.e, list_sum([(x.v[i] - c.c[i]) * (x.v[i] - c.c[i]) for i in range(1, len(x.v) + 1)])::BIGINT AS d FROM x JOIN c{k} c ON c.p = x.p) GROUP BY ALL)"
        )
        if k < rounds:
            steps.append(
                f"m{k} AS (SELECT p, e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{k}, w GROUP BY 1, 2, 3), "
                f"n{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{k} GROUP BY 1, 2), "
                f"c{k + 1} AS (SELECT o.p, o.e, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN n{k} n ON n.p = o.p AND n.e = o.e)"
            )
    return (
        f"WITH r AS MATERIALIZED (SELECT vec_id, label, [floor({grain} * e::DOUBLE)::BIGINT for e in embedding] AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len([e for e in embedding if isfinite(e)]) = len(embedding)), "
        f"x AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM r, (SELECT unnest(range(0, {parts})) AS p)), "
        "w AS (SELECT unnest(range(1, len(v) + 1)) AS i FROM (SELECT v FROM x LIMIT 1)), "
        f"c0 AS (SELECT p, v AS c, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM x QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}), "
        + ", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)
        + f", o AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id), "
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c{rounds}) "
        "SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM o, h"
    )


#: Distinct vec_ids and vectors of one length, as the given table has them.
OP13_SQL = _sql()
