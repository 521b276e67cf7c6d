"""Operator 6: packing documents into sequences by bin completion.

How many pieces there are of each length is all that a packing depends on,
and lengths are at most the capacity: a histogram of some 2048 counts,
whatever the number of documents. The search runs on that histogram: take
the largest piece left, go through the undominated ways to fill the rest of
its sequence, the least waste first, each for as many sequences at once as
there are pieces for and then for fewer, and cut off what would waste more
than the best packing known. That is best fit decreasing at first, or one of
some descents in which fills that waste little count as equal and the largest
pieces go first; later, the sequences laid so far with the rest in best fit. Nothing is left out of the
search: it ends when the bound is met or no better packing is left, or after a
stated number of steps (none for a proof) with the best packing found. The
outcome is a table of patterns, each for many sequences at once, and Spark
deals the pieces of each length to it by their rank, which is counted in many
buckets, so that a length of a third of all pieces is no hot group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import giving_back, parts, read_table, slices, small_batches, stage
from driftline.llm.word_tokens import BATCH_BYTES, default_path, word_tokens

CAPACITY = 2048
END_ID = 0
#: Steps of the search, each a length tried in a sequence: some seconds. None: until the best packing is proven.
STEPS: int | None = 1_000_000
#: Waste that counts as none, of each descent before the search; and lengths tried for a fill before that is doubled.
TOLERANCES, TRIES = (1, 2, 4, 8, 16, 24, 32, 48, 64, 128), 3000
#: The sequences laid are tried with the rest in best fit at every so many laid patterns.
TRY_EVERY = 50

Pattern = tuple[tuple[int, ...], int]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing, many equal sequences at a time."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {capacity: []}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in open_ if r >= size):
            if room == capacity:
                continue
            while left and open_.get(room):
                items, n = open_[room].pop()
                each = room // size
                full = min(n, left // each)
                if full:
                    open_.setdefault(room - each * size, []).append((items + (size,) * each, full))
                    left -= full * each
                    n -= full
                if n and left < each:
                    if left:
                        open_.setdefault(room - left * size, []).append((items + (size,) * left, 1))
                        n, left = n - 1, 0
                    if n:
                        open_[room].append((items, n))
                elif n:
                    open_[room].append((items, n))
        each = capacity // size
        if full := left // each:
            open_.setdefault(capacity - each * size, []).append(((size,) * each, full))
        if left % each:
            open_.setdefault(capacity - left % each * size, []).append(((size,) * (left % each), 1))
    return [p for group in open_.values() for p in group if p[1]]


class OutOfSteps(Exception):
    pass


class Search:
    """The state of a search: pieces left, patterns laid, and the best packing known."""

    def __init__(self, counts: dict[int, int], capacity: int, steps: int | None) -> None:
        self.capacity, self.steps = capacity, steps
        self.left, self.sizes = dict(counts), sorted(counts)
        self.weight = sum(s * n for s, n in counts.items())
        self.least = least_sequences(counts, capacity)
        self.laid: list[Pattern] = []
        self.waste = 0
        self.keep(best_fit(counts, capacity))
        # Sums that pieces of these lengths can have, any number of each: a bit for each sum.
        self.sums = 1
        for size in self.sizes:
            step = size
            while step <= capacity:
                self.sums |= self.sums << step
                step *= 2
        self.sums &= (1 << (capacity + 1)) - 1

    def keep(self, patterns: list[Pattern]) -> None:
        """A better packing has used - 1 sequences at most, so it may waste no more than spare."""
        self.best, self.used = patterns, sum(n for _, n in patterns)
        self.spare = (self.used - 1) * self.capacity - self.weight

    def descend(self, tolerance: int) -> None:
        """Lays a whole packing: at each largest piece the fill of the largest pieces that wastes at most tolerance, or else twice as much."""
        tries = 0

        def fill(rest: int, top: int, waste: int) -> tuple[int, ...] | None:
            nonlocal tries
            tries += 1
            top = min(top, bisect_right(self.sizes, rest))
            if not top:
                return () if rest <= waste else None
            for k in range(top - 1, -1, -1):
                size = self.sizes[k]
                for n in range(min(self.left[size], rest // size), 0, -1):
                    if tries > TRIES:
                        return None
                    more = fill(rest - n * size, k, waste)
                    if more is not None:
                        return (size,) * n + more
            return None

        while self.sizes:
            big, waste, found = self.sizes[-1], tolerance, None
            self.take(big, 1)
            while found is None:
                tries = 0
                found = fill(self.capacity - big, len(self.sizes), waste)
                waste *= 2
            self.take(big, -1)
            pattern = (big, *found)
            self.lay((pattern, min(self.left[s] // k for s, k in Counter(pattern).items())), 1)
        self.complete()
        while self.laid:
            self.lay(self.laid[-1], -1)

    def take(self, size: int, n: int) -> None:
        """n pieces of a size less, or more where n is negative; sizes stays in order."""
        had = self.left.get(size, 0)
        self.left[size] = had - n
        if had == n:
            del self.left[size], self.sizes[bisect_left(self.sizes, size)]
        elif not had:
            insort(self.sizes, size)

    def lay(self, pattern: Pattern, sign: int) -> None:
        items, n = pattern
        for s, k in Counter(items).items():
            self.take(s, sign * k * n)
        self.waste += sign * n * (self.capacity - sum(items))
        if sign > 0:
            self.laid.append(pattern)
        else:
            self.laid.pop()

    def step(self) -> None:
        if self.steps is not None:
            self.steps -= 1
            if self.steps < 0:
                raise OutOfSteps

    def exact(self, rest: int, top: int) -> Iterator[tuple[int, ...]]:
        """All ways to make rest of pieces left, those of the lengths under place top, the largest and the most of it first."""
        self.step()
        top = min(top, bisect_right(self.sizes, rest))
        if not top:
            return
        k = top - 1
        least = self.sizes[0]
        if rest < 2 * least:  # a single piece
            at = bisect_left(self.sizes, rest, 0, top)
            if at < top and self.sizes[at] == rest:
                yield (rest,)
            return
        while k >= 0:
            size = self.sizes[k]
            most = min(self.left[size], rest // size)
            for n in range(most, 0, -1):
                after = rest - n * size
                if not after:
                    yield (size,) * n
                elif after >= least and self.sums >> after & 1:
                    self.step()
                    for more in self.exact(after, k):
                        yield (size,) * n + more
            k -= 1

    def improvable(self, fill: tuple[int, ...], waste: int) -> bool:
        """Whether a piece left over fits beside the fill, or in place of a smaller one of it: then another fill dominates it."""
        if not waste:
            return False
        need = Counter(fill)
        free = lambda size: self.left[size] > need.get(size, 0)
        for low in {0, *fill}:
            for at in range(bisect_right(self.sizes, low), bisect_right(self.sizes, low + waste)):
                if free(self.sizes[at]):
                    return True
        return False

    def fills(self, room: int, start: tuple[int, tuple[int, ...]] | None) -> Iterator[tuple[int, ...]]:
        """The undominated ways to fill room, the least waste first; start: only those after this one (waste, fill)."""
        for waste in range(start[0] if start else 0, room + 1):
            if self.waste + waste > self.spare:
                return
            if not self.sums >> (room - waste) & 1:
                continue
            for fill in self.exact(room - waste, len(self.sizes)) if waste < room else [()]:
                if start and waste == start[0] and fill >= start[1]:
                    continue
                if not self.improvable(fill, waste):
                    yield fill

    def choices(self, last: tuple[int, ...] | None) -> Iterator[Pattern]:
        """Patterns for the largest piece left, each for many sequences first; last: the pattern laid before, if it was for the same length."""
        big = self.sizes[-1]
        room = self.capacity - big
        start = (self.capacity - sum(last), last[1:]) if last and last[0] == big else None
        self.take(big, 1)
        ways = self.fills(room, start)
        while True:
            fill = next(ways, None)  # with the largest piece taken
            if fill is None:
                break
            self.take(big, -1)
            pattern = (big, *fill)
            most = min(self.left[s] // k for s, k in Counter(pattern).items())
            lost = self.capacity - sum(pattern)
            for n in range(most, 0, -1):
                if self.waste + n * lost <= self.spare:
                    yield pattern, n
            self.take(big, 1)
        self.take(big, -1)

    def run(self) -> list[Pattern]:
        stack: list[Iterator[Pattern]] = []
        for tolerance in TOLERANCES:
            if self.used > self.least:
                self.descend(tolerance)
        try:
            while self.used > self.least:
                if self.left:
                    if len(self.laid) % TRY_EVERY == 0 and self.laid:
                        self.complete()
                    stack.append(self.choices(self.laid[-1][0] if self.laid else None))
                else:
                    self.complete()
                    stack.append(iter(()))
                while stack:
                    pattern = next(stack[-1], None)
                    if pattern is not None:
                        self.lay(pattern, 1)
                        break
                    stack.pop()
                    if not stack:
                        return self.best
                    self.lay(self.laid[-1], -1)
        except OutOfSteps:
            self.complete()
        return self.best

    def complete(self) -> None:
        """The sequences laid and the rest in best fit, if that is better than the best packing known."""
        weight = sum(s * n for s, n in self.left.items()) + sum(sum(items) * n for items, n in self.laid)
        if weight != self.weight:  # stopped with a piece in hand
            return
        made = [*self.laid, *best_fit(self.left, self.capacity)]
        if sum(n for _, n in made) < self.used:
            self.keep(made)


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: by the sum, or by pieces over k counted whole and those of k to capacity - k by their sum."""
    sizes = np.array(sorted(counts))
    n = np.array([counts[s] for s in sizes.tolist()], dtype=object)
    if not len(sizes):
        return 0
    best = -(-int((sizes * n).sum()) // capacity)
    for k in {0, *[s for s in sizes.tolist() if s <= capacity // 2]}:
        large = sizes > capacity - k
        half = (sizes > capacity // 2) & ~large
        small = (sizes >= k) & (sizes <= capacity // 2)
        spare = int(n[half].sum()) * capacity - int((sizes * n)[half].sum())
        best = max(best, int(n[large].sum()) + int(n[half].sum()) + max(0, -(-(int((sizes * n)[small].sum()) - spare) // capacity)))
    return best


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY, steps: int | None = STEPS) -> list[Pattern]:
    """Patterns (lengths, number of sequences) that use every piece once; with steps None, of the fewest sequences there can be."""
    counts = {s: n for s, n in counts.items() if n}
    return Search(counts, capacity, steps).run() if counts else []


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, rid): each document's ids and end_id, cut at the capacity. rid names the piece's row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_path)
        serial = TaskContext.get().partitionId() << 36
        for batch in batches:
            for rows in slices(batch, limit=BATCH_BYTES):
                ids, at = tokens.encode(rows.column("text"))
                row, piece, start, size, crc = [], [], [], [], []
                for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], end_id).astype("<u4")
                    for p, s in enumerate(range(0, len(own), capacity)):
                        cut = own[s : s + capacity]
                        row.append(d)
                        piece.append(p)
                        start.append(s)
                        size.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                names = np.arange(serial, serial + len(row))
                serial += len(row)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(names)], ["doc_id", "piece", "start", "length", "ids_crc32", "rid"])

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rid long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs (doc_id, text).

    A null or empty text is the end id alone. Rows that repeat, or have a null
    doc_id, are packed like any other. Longer documents than the capacity are
    cut into pieces of it; the last may be shorter. An empty table: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = stage(pieces_of(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    rows, taken, base = [], Counter(), 0
    patterns = [(Counter(items), n) for items, n in pack_lengths(counts, capacity)]
    uses = Counter(size for need, _ in patterns for size in need)
    # Ranks of a length go to cells, about four for each pattern that has it; a pattern is listed in the cells it reaches.
    cell = {size: max(1, n // (4 * uses[size])) for size, n in counts.items()}
    for need, n in patterns:
        offset = 0
        for size, k in sorted(need.items(), reverse=True):
            low, high = taken[size], taken[size] + n * k
            rows += [(size, c, low, high, k, base, offset) for c in range(low // cell[size], (high - 1) // cell[size] + 1)]
            taken[size] = high
            offset += size * k
        base += n
    plan = F.broadcast(spark.createDataFrame(rows, "size long, cell long, low long, high long, each long, base long, first long"))
    widths = F.broadcast(spark.createDataFrame(sorted(cell.items()), "_size long, width long"))
    # The rank of a piece among those of its length: its bucket's pieces before it, and the buckets before.
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(4 * parts(docs))).cast("int"))
    before = pieces.groupBy("length", "bucket").count().withColumn("before", F.sum("count").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select(F.col("length").alias("_length"), F.col("bucket").alias("_bucket"), F.coalesce("before", F.lit(0)).alias("before"))
    ranked = pieces.withColumn("n", F.row_number().over(W.partitionBy("length", "bucket").orderBy("rid")))
    ranked = ranked.join(before, (F.col("length") == F.col("_length")) & (F.col("bucket") == F.col("_bucket"))).withColumn("rank", F.col("before") + F.col("n") - 1)
    ranked = ranked.join(widths, F.col("length") == F.col("_size")).withColumn("of", F.floor(F.col("rank") / F.col("width")))
    out = ranked.join(plan, (F.col("length") == F.col("size")) & (F.col("of") == F.col("cell")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at = F.col("rank") - F.col("low")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"), (F.col("first") + at % F.col("each") * F.col("length")).cast("long").alias("offset"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), default_path())
