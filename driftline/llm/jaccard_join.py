"""Operator 1: similarity join of documents on word shingles.

Method: prefix filters under several global orders of the shingles. Any two
sets with Jaccard similarity t share a shingle among the first
``n - ceil(t * n) + 1`` of each, whatever the order, so long as both use the
same one. Here every order puts the corpus-wide frequent shingles last, those
of the most documents at the very end, and orders the others by differently
seeded hashes. A pair is a candidate only if its prefixes meet under every
order, and in enough shingles that what follows the prefixes could make up for
the rest; only candidates are compared.

Steps, all of them Spark jobs over all documents:

1. equal sets become one class (exact copies take no further part);
2. document frequencies of all shingles, exchanged as packed cells;
3. prefixes under each order; groups of a rare shingle are small by
   construction, so their pairs are made there, and pairs that every order lets
   through are compared one by one;
4. classes with fewer rare shingles than their prefix is long meet in frequent
   shingles too. Two of them that share no rare shingle can only link if the
   frequent shingles of each are enough for the overlap; then one of the two
   must have enough for a set of its own size. A group without such a member
   makes no pairs, the others are tied to one of them: near copies of many
   documents, which are compared by blocks, so no group is ever paired in full;
5. the links found are joined to components.

Every link between different sets is found: prefixes are exact and nothing is
capped. Which shingles count as frequent changes the way, not the result: it
is kept in bit tables of up to 64 MB, sized by what they hold, where a shingle
may be taken for a more frequent one. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import packed
from driftline.llm.common import giving_back, keep_ids, keep_rows, parts, read_table, slices, small_batches, stage, text_buffer
from driftline.llm.components import Forest, connected_components
from driftline.llm.hashing import U64, mix, shingle_sets

#: A shingle in more than so many classes is frequent, and the more so the more of these it exceeds.
FREQUENT = (16, 256, 4096, 65536)
#: Bits of the tables that tell frequent shingles, for each shingle that a table holds, and bits of a table at most (64 MB), as a power of two.
TABLE_LOAD, TABLE_MOST = 8, 29
#: Bits of a piece of a table, as a power of two: what one row brings to the driver.
_PIECE = 18
#: Seeds of the orders; order 0 is that of the hashes themselves.
ORDER_SEEDS = (0, 0x5BD1E995)
#: A block of a family: members and shingles.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 400_000
_KEY_BITS = 48
#: Shingles that a task sorts at a time, and that a shard has about.
_CHUNK = 1_000_000
#: Sets of a table of names that may be broadcast (about 150 bytes each); a larger one is shuffled.
BROADCAST_SETS = 200_000


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for piece in slices(batch):
        yield piece, *shingle_sets(*text_buffer(piece.column("text")), width)


def _set_ids(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set, from all its shingles and their number."""
    sums = np.concatenate([[U64(0)], np.cumsum(mix(values ^ U64(0xA5A5A5A5A5A5A5A5)), dtype=U64)])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(U64)).view(np.int64)


def document_sets(docs: DataFrame, width: int = 5, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, also, n_shingles, set_id) of every row; set_id is null for texts without words."""
    held = ("doc_id", *also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, values, at in _sets(batch, width):
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in held], pa.array(n), pa.array(_set_ids(values, at), mask=n == 0)], [*held, "n_shingles", "set_id"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in held)
    return docs.select(*held, "text").mapInArrow(giving_back(run), f"{kinds}, n_shingles long, set_id long")


def _frequencies(docs: DataFrame, width: int, shards: int) -> DataFrame:
    """(bucket, df) of the shingle buckets (top 48 bits) in more documents than the least of FREQUENT."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def cells() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held) >> U64(64 - _KEY_BITS))
            held.clear()
            at = packed.cut(keys, shards, _KEY_BITS)
            full = np.flatnonzero(np.diff(at))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([packed.pack_sorted(keys[at[k] : at[k + 1]]) for k in full], pa.binary())], ["shard", "keys"])

        size = 0
        for batch in batches:
            for _, values, _ in _sets(batch, width):
                held.append(values)
                size += len(values)
                if size >= _CHUNK:
                    yield cells()
                    size = 0
        if size:
            yield cells()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in packed.groups(batches, "shard"):
            keys = np.sort(np.concatenate([packed.unpack_sorted(x.as_py()) for x in group.column("keys")]))
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            df = np.diff(np.append(first, len(keys)))
            often = df > FREQUENT[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys[first[often]].view(np.int64)), pa.array(df[often])], ["bucket", "df"])

    cells = docs.select("doc_id", "text").mapInArrow(giving_back(send), "shard int, keys binary")
    return cells.repartition("shard").sortWithinPartitions("shard").mapInArrow(giving_back(count), "bucket long, df long")


def _table_places(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Where the shingles of the top _KEY_BITS bits are told about in a table of 2**bits bits."""
    return (mix(shingles >> U64(64 - _KEY_BITS)) >> U64(64 - bits)).astype(np.int64)


def _frequent(table: DataFrame) -> list[np.ndarray]:
    """A packed bit table for each bound of FREQUENT, as large as the number of its shingles asks for."""
    number = table.agg(*[F.count(F.when(F.col("df") > least, 1)) for least in FREQUENT]).first()
    sizes = [min(max((TABLE_LOAD * n).bit_length(), _PIECE), TABLE_MOST) for n in number]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, df = batch.column("bucket").to_numpy().view(U64) << U64(64 - _KEY_BITS), batch.column("df").to_numpy()
            for level, (least, bits) in enumerate(zip(FREQUENT, sizes, strict=True)):
                places = np.unique(_table_places(keys[df > least], bits))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), level, np.int32)), pa.array(places >> _PIECE), pa.array(places & ((1 << _PIECE) - 1))], ["level", "piece", "bit"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in packed.groups(batches, "name"):
            cells = np.zeros(1 << _PIECE, bool)
            cells[group.column("bit").to_numpy()] = True
            yield pa.RecordBatch.from_arrays([group.column("level")[:1].combine_chunks(), group.column("piece")[:1].combine_chunks(), pa.array([np.packbits(cells).tobytes()], pa.binary())], ["level", "piece", "cells"])

    rows = table.mapInArrow(giving_back(mark), "level int, piece long, bit long").withColumn("name", F.col("piece") * len(FREQUENT) + F.col("level"))
    pieces = rows.repartition("name").sortWithinPartitions("name").mapInArrow(giving_back(fill), "level int, piece long, cells binary").collect()
    out = [np.zeros((1 << bits) // 8, np.uint8) for bits in sizes]
    for r in pieces:
        out[r["level"]][r["piece"] << (_PIECE - 3) : (r["piece"] + 1) << (_PIECE - 3)] = np.frombuffer(r["cells"], np.uint8)
    return out


def _levels(shingles: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """How frequent each shingle is: 0 for a rare one."""
    out = np.zeros(len(shingles), np.int64)
    some = np.arange(len(shingles))
    for level, table in enumerate(tables, 1):
        at = _table_places(shingles[some], (8 * len(table)).bit_length() - 1)
        some = some[table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1]
        out[some] = level
    return out


def _postings(docs: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """(order_no, shingle, set_id, size, many, saturated, hot): the prefixes; many: the set's frequent shingles. Hot ones are of order 0 only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = frequent.value
        for batch in batches:
            for _, values, at in _sets(batch, width):
                if not len(values):
                    continue
                n = np.diff(at)
                ids = _set_ids(values, at)
                doc = np.repeat(np.arange(len(n)), n)
                prefix = n - (percent * n + 99) // 100 + 1
                level = _levels(values, tables)
                hot = level > 0
                rare = np.bincount(doc, weights=~hot, minlength=len(n)).astype(np.int64)
                saturated = rare < prefix

                def rank(mask: np.ndarray, at=at, doc=doc) -> np.ndarray:
                    """Place among its document's shingles in the mask, by the present order."""
                    seen = np.concatenate([[0], np.cumsum(mask)])
                    return seen[:-1] - seen[at[:-1]][doc]

                for k, seed in enumerate(ORDER_SEEDS):
                    if k:
                        key = (doc.astype(U64) << U64(44)) | (mix(values ^ U64(seed)) >> U64(20))
                        by = np.argsort(key, kind="stable")
                    else:
                        by = np.arange(len(values))
                    is_hot = hot[by]
                    take = by[~is_hot & (rank(~is_hot) < prefix[doc])]
                    rows = [(take, False)]
                    if not k:
                        late = np.lexsort((values, level, doc))
                        is_late = hot[late]
                        rows.append((late[is_late & (rank(is_late) < (prefix - rare)[doc])], True))
                    for take, flag in rows:
                        d = doc[take]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(take), k, np.int8)), pa.array(values[take].view(np.int64)), pa.array(ids[d]), pa.array(n[d].astype(np.int32)), pa.array((n - rare)[d].astype(np.int32)), pa.array(saturated[d]), pa.array(np.full(len(take), flag))],
                            ["order_no", "shingle", "set_id", "size", "many", "saturated", "hot"],
                        )

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "order_no byte, shingle long, set_id long, size int, many int, saturated boolean, hot boolean")


def _pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(u, v) whose prefixes share enough rare shingles under every order, and whose sizes can reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def pair(cols: list[np.ndarray]) -> pa.RecordBatch:
            order, shingle, node, size, many, full = cols
            found = []
            step = 1
            while step < len(node):
                same = np.flatnonzero((shingle[step:] == shingle[:-step]) & (order[step:] == order[:-step]))
                if not len(same):
                    break
                i, j = same, same + step
                i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
                small, large = np.minimum(size[i], size[j]).astype(np.int64), np.maximum(size[i], size[j]).astype(np.int64)
                ok = (node[i] != node[j]) & (100 * small >= percent * large)
                i, j = i[ok], j[ok]
                found.append(np.stack([node[i], node[j], *[x.astype(np.int64) for x in (order[i], size[i], size[j], np.minimum(many[i], many[j]), full[i] & full[j])]]))
                step += 1
            out = np.concatenate(found, axis=1) if found else np.empty((7, 0), np.int64)
            times = np.ones(out.shape[1], np.int64)
            if out.shape[1]:
                out = out[:, np.lexsort(out[:3])]
                first = np.flatnonzero(np.concatenate([[True], (out[:3, 1:] != out[:3, :-1]).any(axis=0)]))
                times = np.diff(np.append(first, out.shape[1]))
                out = out[:, first]
            return pa.RecordBatch.from_arrays([*[pa.array(x) for x in out], pa.array(times)], ["u", "v", "order_no", "size_u", "size_v", "many", "saturated", "shared"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("order_no", "shingle", "set_id", "size", "many", "saturated")]
            if kept:
                cols = [np.concatenate([a, b]) for a, b in zip(kept, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[1] != cols[1][-1]) | (cols[0] != cols[0][-1]))
            end = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            kept = [c[end:] for c in cols]
            if end:
                yield pair([c[:end] for c in cols])
        if kept and len(kept[0]):
            yield pair(kept)

    rows = postings.where("not hot").repartition("order_no", "shingle").sortWithinPartitions("order_no", "shingle")
    pairs = rows.select("order_no", "shingle", "set_id", "size", "many", "saturated").mapInArrow(giving_back(run), "u long, v long, order_no long, size_u long, size_v long, many long, saturated long, shared long")
    shared = [F.sum(F.when(F.col("order_no") == k, F.col("shared")).otherwise(0)).alias(f"shared_{k}") for k in range(len(ORDER_SEEDS))]
    pairs = pairs.groupBy("u", "v").agg(F.max("size_u").alias("a"), F.max("size_v").alias("b"), F.max("many").alias("many"), F.max("saturated").alias("saturated"), *shared)
    # Beyond what the prefixes share, the overlap is at most what one of the sets has after its prefix: ceil(t * size) - 1.
    overlap = F.ceil(percent * (F.col("a") + F.col("b")) / (100 + percent))
    after = F.greatest(*[F.ceil(percent * F.col(c) / 100) - 1 for c in "ab"])
    least = F.greatest(overlap - after, F.lit(1))
    every = F.least(*[F.col(f"shared_{k}") for k in range(len(ORDER_SEEDS))]) >= least
    # All rare shingles of a saturated set are in its prefixes; two such sets share no more frequent ones than either has.
    both = F.least(*[F.col(f"shared_{k}") for k in range(len(ORDER_SEEDS))]) + F.col("many") >= overlap
    return pairs.where(F.when(F.col("saturated") == 1, both).otherwise(every)).select("u", "v")


def _ties(hot: DataFrame, percent: int) -> DataFrame:
    """(u, v) that join the sets of each frequent shingle that may link without a common rare one.

    Such a pair needs an overlap that the frequent shingles of both can give:
    the other set has reach shingles at most. The smaller of two that link has
    itself within its reach.
    """
    rows = hot.withColumn("reach", F.floor(F.col("many") * (100 + percent) / percent) - F.col("size"))
    able = F.col("reach") >= F.col("size")
    pivots = rows.where(able).groupBy("shingle").agg(F.min("set_id").alias("v"), F.min("size").alias("least"))
    tied = rows.join(pivots, "shingle").where((F.col("reach") >= F.col("least")) & (F.col("set_id") != F.col("v")))
    return tied.select(F.col("set_id").alias("u"), "v").distinct()


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of all sets in left with all in right."""
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    column = np.cumsum(np.concatenate([[True], tokens[1:] != tokens[:-1]])) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.cumsum(np.concatenate([[0], np.diff(column[shared]) != 0])) if shared.any() else column[shared]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        cells = np.zeros((len(sets), width), np.float32)
        cells[owner[lo:hi], column[lo:hi] - start] = 1
        out += cells[left] @ cells[right].T
    return out.astype(np.int64)


def _verify(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the sets of a task, the listed pairs or all of one block with those of another; a row for each set: its root there and its number of links."""

    def compare(group: pa.Table) -> pa.RecordBatch:
        listed = group.filter(pc.is_valid(group.column("other")))
        seats = group.filter(pc.is_null(group.column("other")))
        nodes, block = seats.column("set_id").to_numpy(), seats.column("block").to_numpy()
        by = np.lexsort((nodes, block))
        by = by[np.concatenate([[True], nodes[by][1:] != nodes[by][:-1]])]
        nodes, block = nodes[by], block[by]
        sets = [np.frombuffer(x, U64) for x in seats.column("shingles").take(pa.array(by)).to_pylist()]
        n = np.array([len(x) for x in sets], np.int64)
        if listed.num_rows:
            place = np.argsort(nodes)
            i, j = (place[np.searchsorted(nodes[place], listed.column(c).to_numpy())] for c in ("set_id", "other"))
            both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
            linked = 100 * both >= percent * (n[i] + n[j] - both)
            i, j = i[linked], j[linked]
        else:
            a = int(np.searchsorted(block, block[-1]))
            left, right = (np.arange(a), np.arange(a, len(nodes))) if a else (np.arange(len(nodes)),) * 2
            both = _common(sets, left, right)
            linked = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
            if not a:
                linked = np.triu(linked, 1)
            i, j = np.nonzero(linked)
            i, j = left[i], right[j]
        degree = np.bincount(i, minlength=len(nodes)) + np.bincount(j, minlength=len(nodes))
        forest = Forest()
        for x, y in zip(nodes[i].tolist(), nodes[j].tolist(), strict=True):
            forest.union(x, y)
        roots = [forest.find(x) for x in nodes.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots, pa.int64()), pa.array(degree)], ["node", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in packed.groups(batches, "task"):
            yield compare(group)

    return run


def _blocks(members: DataFrame) -> DataFrame:
    """members (component, set_id, n) with the block of its component that each is in, and how many there are."""
    number = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_MEMBERS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int")
    sizes = members.groupBy("component").agg(number.alias("blocks"))
    return members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))


def _task(kind: str, low: Column, high: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), "component", low.cast("string"), high.cast("string"))


def _tasks(pairs: DataFrame, ties: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set_id, task, block) of the sets that each task compares, and (task, set_id, other) of the pairs it compares if not all."""
    size = classes.select("set_id", "n")
    dense = stage(connected_components(ties), "families").select(F.col("node").alias("set_id"), "component")
    dense = stage(_blocks(dense.join(size, "set_id")), "dense")
    every = dense.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    seats = every.select("set_id", _task("all", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "block")
    family = dense.select("set_id", F.col("component").alias("family"))
    of = lambda c: family.select(F.col("set_id").alias(c), F.col("family").alias(f"family_{c}"))
    listed = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").where("family_u is null or family_v is null or family_u != family_v").select("u", "v")
    listed = stage(listed, "pairs")
    groups = stage(connected_components(listed), "groups").select(F.col("node").alias("set_id"), "component")
    groups = stage(_blocks(groups.join(size, "set_id")), "sparse")
    end = lambda c: groups.select(F.col("set_id").alias(c), "component", F.col("block").alias(f"block_{c}"))
    listed = listed.join(end("u"), "u").join(end("v").drop("component"), "v")
    listed = stage(listed.withColumn("task", _task("some", F.least("block_u", "block_v"), F.greatest("block_u", "block_v"))), "listed")
    some = listed.select(F.col("u").alias("set_id"), "task", F.col("block_u").alias("block")).union(listed.select("v", "task", "block_v")).distinct()
    return seats.union(some), listed.select("task", F.col("u").alias("set_id"), F.col("v").alias("other"))


def _joined(docs: DataFrame, percent: int, width: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, also, n_shingles, component, component_id, n_links) of every row; component names what links reach, and is null for rows that link with nothing."""
    spark = docs.sparkSession
    small_batches(spark)
    sets = stage(document_sets(docs, width, also), "sets")
    docs = docs.select("doc_id", "text")
    docs = docs.where("doc_id is not null")
    classes = sets.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    classes = stage(classes, "classes")
    # Rows that only repeat an earlier set are left out of the scans below.
    extra = sets.join(classes.select("doc_id").distinct(), "doc_id", "left_anti").where("doc_id is not null").select("doc_id").distinct()
    n_extra = extra.count()
    firsts = keep_ids(docs, extra, n_extra, "left_anti") if n_extra else docs

    shingles = sets.agg(F.sum("n_shingles")).first()[0] or 0
    table = stage(_frequencies(firsts, width, max(4 * parts(docs), shingles // _CHUNK)), "frequent")
    frequent = spark.sparkContext.broadcast(_frequent(table))
    postings = _postings(firsts, width, percent, frequent)
    ties = _ties(stage(postings.where("hot").select("shingle", "set_id", "size", "many"), "hot"), percent)
    seats, listed = _tasks(stage(_pairs(postings, percent), "candidates"), ties, classes)
    chosen = seats.groupBy("set_id").agg(F.collect_list(F.struct("task", "block")).alias("seats"))
    chosen = stage(chosen.join(classes.select("set_id", F.col("doc_id").alias("_id")), "set_id").withColumnRenamed("set_id", "_set"), "seats")
    n_members = chosen.count()
    chosen = F.broadcast(chosen) if n_members <= BROADCAST_SETS else chosen

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, values, at in _sets(batch, width):
                ids = _set_ids(values, at)
                keep = np.flatnonzero(ids == piece.column("_set").to_numpy())
                yield pa.RecordBatch.from_arrays([piece.column("seats").take(pa.array(keep)), pa.array(ids[keep]), pa.array([values[at[k] : at[k + 1]].tobytes() for k in keep], pa.binary())], ["seats", "set_id", "shingles"])

    rows = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_id"])).select("text", "seats", "_set").mapInArrow(giving_back(pack), "seats array<struct<task:string,block:int>>, set_id long, shingles binary")
    rows = rows.select(F.explode("seats").alias("seat"), "set_id", "shingles").select("seat.task", "set_id", F.lit(None).cast("long").alias("other"), "seat.block", "shingles")
    rows = rows.unionByName(listed.select("task", "set_id", "other", F.lit(None).cast("int").alias("block"), F.lit(None).cast("binary").alias("shingles")))
    found = rows.repartition("task").sortWithinPartitions("task").mapInArrow(giving_back(_verify(percent)), "node long, root long, links long")
    found = stage(found, "links")
    component = connected_components(found.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))

    mapped = classes.join(component, classes["set_id"] == component["node"], "left").drop("node").join(degree, F.col("set_id") == degree["node"], "left")
    mapped = mapped.select("set_id", "doc_id", F.coalesce("component", "set_id").alias("component"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"))
    least = mapped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    mapped = stage(mapped.join(least, "component").select(F.col("set_id").alias("_set"), "component", "component_id", "n_links"), "mapped")
    out = sets.join(mapped, sets["set_id"] == mapped["_set"], "left")
    alone = F.col("set_id").isNull() | F.col("doc_id").isNull()
    return out.select(
        "doc_id", *also, "n_shingles", F.when(~alone, F.col("component")).alias("component"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
    )


def jaccard_join(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of docs (doc_id, text; other columns are ignored).

    Two rows link when 100 * |A & B| >= percent * |A | B| for their shingle
    sets. component_id is the smallest doc_id that links reach, itself
    included; n_links is the number of different other sets that this row's
    set links to. Null or wordless texts have no shingles, link with nothing
    and have their own doc_id as component_id. Rows with equal sets, repeated
    rows among them, link. Rows with a null doc_id link with nothing and have
    a null component_id. Very long texts are read whole. An empty table gives
    no rows.
    """
    return _joined(docs, percent, width).drop("component")


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs without the rows that link to an earlier one: of the rows that links reach the first stays, by doc_id and then by a hash of the text.

    Rows are judged by their own texts: unlike texts under one doc_id all
    stay. Null and wordless texts, and rows without a doc_id, link with
    nothing and stay. Of rows that repeat doc_id and text one stays, that of
    the least hash of all columns. Columns and types are those of docs,
    whatever their names. An empty table stays empty. Very long texts are
    compared whole.
    """
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    rows = _joined(docs.select("doc_id", "text", key.alias("_row")), percent, width, ("_row",)).where("component is not null")
    rows = stage(rows.groupBy("component", "doc_id", "_row").agg(F.count("*").alias("times")), "reached")
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "_row")).alias("first"))
    rows = rows.join(first, "component").withColumn("late", F.struct("doc_id", "_row") != F.col("first"))
    rows = stage(rows.where("late or times > 1").select("doc_id", "_row", "late"), "told")
    late, again = rows.where("late"), rows.where("not late")
    n_late, n_again = late.count(), again.count()
    kept = keep_rows(docs, late, n_late, key, "left_anti") if n_late else docs
    if not n_again:
        return kept
    named = [c for c in docs.columns if not docs.schema[c].dataType.simpleString().startswith("map")]
    once = keep_rows(kept, again, n_again, key).groupBy(F.col("doc_id").alias("_doc"), key.alias("_key")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*named)).alias("_all"))
    return keep_rows(kept, again, n_again, key, "left_anti").unionByName(once.select("_all.*"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))
