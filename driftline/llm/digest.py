"""Operator 3: similarity digests of improbable features.

Every place of a text has the window of bytes that begins there and lies in
the text. How rare a window's entropy is among all windows of the corpus (a
Spark aggregate) ranks it, the rarest first, windows of little entropy last. A
window that is the best of many of its neighbourhoods is a feature; in a text
whose windows all fit into one filter every window is. Short texts have
features of narrower windows beside them, by their length: any two texts of
which one is at most twice as long as the other have windows of a common width.
Features go, in order, into Bloom filters of 2048 bits, a new one after every
160 features: the chains of filters, one for each width, are the fingerprint.
Two fingerprints are compared filter by filter: the common bits beyond chance,
as a share of the most there could be, by the width that tells most.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import giving_back, parts, read_table, slices, small_batches, text_buffer
from driftline.llm.hashing import U64, span_hashes

#: Bytes of a window, and of the windows of texts that are at least so long and less than NARROW times as long.
WINDOW, WIDTHS, NARROW = 16, (1, 2, 4, 8), 8
#: Steps that entropies are rounded to, and the step below which a window tells little.
BINS, DULL = 1000, 400
#: A feature is the best in at least this share of the neighbourhoods it could be the best in.
POPULAR = 4
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Overlap that counts as none: this share of the way from chance to the most.
NOISE = 0.1
BATCH_BYTES = 1 << 20
#: Filters of a text that are compared at a time with as many of another.
COMPARED = 512


def entropies(buf: np.ndarray, width: int) -> np.ndarray:
    """The entropy of buf[i : i + width] for each i, in steps from 0 to BINS (all bytes different).

    Many stretches of buf are scanned side by side, a byte each at a time.
    """
    n = len(buf) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    lanes = max(1, min(8192, n // (4 * width)))
    length = -(-n // lanes)
    padded = np.zeros(lanes * length + width, np.uint8)
    padded[: len(buf)] = buf
    columns = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (lanes, length + width - 1), (length, 1)).T)
    c = np.arange(1, width + 1)
    cost = np.concatenate([[0], np.round(4096 * c * np.log2(c))]).astype(np.int32)
    step = np.diff(cost, prepend=0).astype(np.int32)
    counts = np.zeros(lanes * 256, np.uint8)
    base = np.arange(lanes) * 256
    total = np.zeros(lanes, np.int32)
    out = np.empty((length, lanes), np.int32)
    for t in range(length + width - 1):
        if t >= width:
            place = base + columns[t - width]
            have = counts.take(place)
            total -= step.take(have)
            counts[place] = have - 1
        place = base + columns[t]
        have = counts.take(place) + 1
        total += step.take(have)
        counts[place] = have
        if t >= width - 1:
            out[t - width + 1] = total
    return BINS - out.T.reshape(-1)[:n].astype(np.int64) * BINS // int(cost[width])


def _whole(off: np.ndarray, width: int) -> np.ndarray:
    """At which places a window of width bytes lies in one text."""
    inside = np.zeros(int(off[-1]) + 1, np.int64)
    some = np.diff(off) >= width
    np.add.at(inside, off[:-1][some], 1)
    np.add.at(inside, off[1:][some] - (width - 1), -1)
    return np.cumsum(inside[:-1]) > 0


def entropy_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts have each entropy: BINS + 1 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS + 1, np.int64)
        for batch in batches:
            for piece in slices(batch, limit=BATCH_BYTES):
                buf, off = text_buffer(piece.column("text"))
                bins = entropies(buf, WINDOW)
                counts += np.bincount(bins[_whole(off, WINDOW)[: len(bins)]], minlength=BINS + 1)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tolist()], pa.list_(pa.int64()))], ["counts"])

    cells = docs.select("text").mapInArrow(giving_back(run), "counts array<long>").select(F.posexplode("counts").alias("bin", "n"))
    out = np.zeros(BINS + 1, np.int64)
    for r in cells.where("n > 0").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy, 0 for the rarest; dull ones last, the dullest at the very end."""
    order = sorted(range(BINS + 1), key=lambda b: (b < DULL, int(counts[b]) if b >= DULL else -b, b))
    ranks = np.empty(BINS + 1, np.int64)
    ranks[order] = np.arange(BINS + 1)
    return ranks


def popular(buf: np.ndarray, off: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Places of the windows of WINDOW bytes that are features: all of a text that has no more than FILTER_FEATURES, else the popular ones (any that is best somewhere, if none is popular)."""
    bins = entropies(buf, WINDOW)
    whole = _whole(off, WINDOW)[: len(bins)]
    key = (np.where(whole, ranks[bins], BINS + 1) << 32) | np.arange(len(bins))
    span = 1
    while span < WINDOW and len(key) > span:  # the best of WINDOW windows in a row, the first of equals
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    inner = np.flatnonzero(whole[: len(key)] & whole[WINDOW - 1 : WINDOW - 1 + len(key)]) if span == WINDOW else np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inner = inner[text_of[inner] == text_of[inner + WINDOW - 1]]
    votes = np.bincount(key[inner] & 0xFFFFFFFF, minlength=len(bins))
    few = np.diff(off) < FILTER_FEATURES + WINDOW
    chosen = votes >= WINDOW // POPULAR
    none = ~few & (np.bincount(text_of[np.flatnonzero(chosen)], minlength=len(few)) == 0)
    at = text_of[: len(bins)]
    return np.flatnonzero(whole & np.where(few[at], True, chosen | (none[at] & (votes > 0))))


def features(buf: np.ndarray, off: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's features in order, equal ones once, and the chain of each: the text's number times len(WIDTHS) + 1, and the number of the width."""
    chains = len(WIDTHS) + 1
    size = np.diff(off)
    text_of = np.repeat(np.arange(len(size)), size)
    hashes, chain, place = [], [], []
    for k, width in enumerate((*WIDTHS, WINDOW)):
        if width == WINDOW:
            at = popular(buf, off, ranks)
        else:
            at = np.flatnonzero(_whole(off, width) & ((size >= width) & (size < NARROW * width))[text_of])
        hashes.append(span_hashes(buf, at, at + width))
        chain.append(text_of[at] * chains + k)
        place.append(at)
    hashes, chain, place = (np.concatenate(x) for x in (hashes, chain, place))
    order = np.lexsort((place, hashes, chain))
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (chain[order][1:] != chain[order][:-1])
    kept = order[first]
    kept = kept[np.lexsort((place[kept], chain[kept]))]
    return hashes[kept], chain[kept]


def filters(hashes: np.ndarray, chain: np.ndarray, chains: int) -> tuple[np.ndarray, np.ndarray]:
    """The filters of all chains (rows of FILTER_BITS / 8 bytes), and the offsets of each chain's."""
    counts = np.bincount(chain, minlength=chains)
    at = np.concatenate([[0], np.cumsum(-(-counts // FILTER_FEATURES))])
    place = np.arange(len(chain)) - np.concatenate([[0], np.cumsum(counts)])[chain]
    row = at[chain] + place // FILTER_FEATURES
    made = np.zeros(int(at[-1]) * (FILTER_BITS // 8), np.uint8)
    for k in range(HASHES):
        bit = (hashes >> U64(11 * k) & U64(FILTER_BITS - 1)).astype(np.int64)
        np.bitwise_or.at(made, row * (FILTER_BITS // 8) + (bit >> 3), (128 >> (bit & 7)).astype(np.uint8))
    return made.reshape(-1, FILTER_BITS // 8), at


#: A fingerprint: the filters of each width that the text has, a row of FILTER_BITS / 8 bytes each.
Fingerprint = dict[int, np.ndarray]


def fingerprints(texts: list[str | None], ranks: np.ndarray) -> list[Fingerprint]:
    """The fingerprint of each text; an empty text has no filters."""
    buf, off = text_buffer(pa.array(texts, pa.large_string()))
    widths = (*WIDTHS, WINDOW)
    made, at = filters(*features(buf, off, ranks), len(texts) * len(widths))
    at = at.tolist()
    return [{w: made[at[k + j] : at[k + j + 1]] for j, w in enumerate(widths) if at[k + j + 1] > at[k + j]} for k in range(0, len(texts) * len(widths), len(widths))]


def written(fingerprint: Fingerprint) -> str:
    return ";".join(f"{w}:{base64.b64encode(f.tobytes()).decode()}" for w, f in fingerprint.items())


def parsed(text: str) -> Fingerprint:
    parts_ = [x.split(":") for x in text.split(";") if x]
    return {int(w): np.frombuffer(base64.b64decode(f), np.uint8).reshape(-1, FILTER_BITS // 8) for w, f in parts_}


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    """Of two chains: each filter of the shorter one by the most like of the other. Some filters of each are unpacked at a time."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    best = [np.zeros(len(a)), np.zeros(len(b))]
    bits = [np.zeros(len(a)), np.zeros(len(b))]
    for i in range(0, len(a), COMPARED):
        x = np.unpackbits(a[i : i + COMPARED], axis=1).astype(np.float32)
        m = bits[0][i : i + COMPARED] = x.sum(axis=1)
        for j in range(0, len(b), COMPARED):
            y = np.unpackbits(b[j : j + COMPARED], axis=1).astype(np.float32)
            n = bits[1][j : j + COMPARED] = y.sum(axis=1)
            most = np.minimum(m[:, None], n[None, :])
            chance = np.outer(m, n) / FILTER_BITS
            floor = chance + NOISE * (most - chance)
            score = np.clip((x @ y.T - floor) / np.maximum(most - floor, 1e-6), 0, 1)
            best[0][i : i + COMPARED] = np.maximum(best[0][i : i + COMPARED], score.max(axis=1))
            best[1][j : j + COMPARED] = np.maximum(best[1][j : j + COMPARED], score.max(axis=0))
    ways = [float((s * n).sum() / n.sum()) for s, n in zip(best, bits, strict=True)]
    return ways[0] if len(a) < len(b) else ways[1] if len(b) < len(a) else sum(ways) / 2


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """From 0 to 1; 1 for equal fingerprints, those of empty texts among them, and 0 without a common width. The most that a common width tells."""
    if not a or not b:
        return float(not a and not b)
    return max((_alike(a[w], b[w]) for w in a if w in b), default=0.0)


def edited(text: str, following: str) -> str:
    """text with its last third, rounded down, replaced by as many of the first code points of the following text (or all of it)."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _bucket(cuts: list[int]) -> Column:
    """How many of the cuts (descending) are over doc_id; null ids come last."""
    group = 64
    array = lambda x: F.array(*[F.lit(c) for c in x])
    over = lambda x: F.size(F.filter(x, lambda c: c > F.col("doc_id")))
    if not cuts:
        near = F.lit(0)
    else:
        coarse = over(array(cuts[::group]))
        near = F.when(coarse == 0, 0).otherwise((coarse - 1) * group + over(F.slice(array(cuts), (coarse - 1) * group + 1, group)))
    return F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(near)


def with_following(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in buckets of neighbouring doc_ids, each bucket in descending order and ended by the first row of the next one (ended: true).

    Rows of equal doc_id are in the order of a hash of their texts, null ids come last; the last row is followed by the first.
    """
    spark, n = docs.sparkSession, parts(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted({int(x) for x in rows.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [k / (4 * n) for k in range(1, 4 * n)], 0.05 / n)}, reverse=True)
    rows = rows.withColumn("bucket", _bucket(cuts)).withColumn("h", F.xxhash64("text"))
    place = F.struct((-F.col("doc_id")).alias("k"), F.col("h").alias("h"))
    leads = sorted(rows.groupBy("bucket").agg(F.min(place).alias("p")).collect(), key=lambda r: r["bucket"])  # one for each bucket
    ended = [(r["p"]["k"], r["p"]["h"], leads[k - 1]["bucket"]) for k, r in enumerate(leads)]
    table = F.broadcast(spark.createDataFrame(ended, "k long, lead long, before int"))
    last = rows.join(table, (-F.col("doc_id")).eqNullSafe(F.col("k")) & (F.col("h") == F.col("lead")))
    last = last.dropDuplicates(["before"]).select("doc_id", "text", F.col("before").alias("bucket"), "h", F.lit(True).alias("ended"))
    rows = rows.withColumn("ended", F.lit(False)).unionByName(last)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "ended", F.col("doc_id").desc_nulls_last(), "h").select("doc_id", "text", "bucket", "ended")


def digest_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs (doc_id BIGINT, text).

    The edited text is that of ``edited`` with the next row in descending
    order of doc_id, the first after the last. A null text is empty and has
    the fingerprint of no filters. Rows that repeat a doc_id follow each other
    in the order of a hash of their texts, null doc_ids come last; each row
    has its own result. Only one row: it follows itself. An empty table gives
    no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    ranks = docs.sparkSession.sparkContext.broadcast(rarity(entropy_counts(docs)))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def results(rows: list[tuple[int | None, str, bool]]) -> pa.RecordBatch:
        """Of all rows but the last, and but those that only end a bucket."""
        own = fingerprints([x[1] for x in rows], ranks.value)
        told = [k for k in range(len(rows) - 1) if not rows[k][2]]
        changed = [edited(rows[k][1], rows[k + 1][1]) for k in told]
        new = fingerprints(changed, ranks.value)
        out = [
            (rows[k][0], len(rows[k][1]), hashlib.sha256(text.encode()).hexdigest(), written(own[k]), written(f), likeness(own[k], f), likeness(own[k], own[k + 1]))
            for k, text, f in zip(told, changed, new, strict=True)
        ]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str, bool]] = []
        size = 0
        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("ended").to_pylist(), strict=True):
                held.append(row)
                size += len(row[1])
                if size >= BATCH_BYTES and len(held) > 1:
                    yield results(held)
                    held = held[-1:]
                    size = len(held[0][1])
        if held:
            yield results(held)

    return with_following(docs).mapInArrow(giving_back(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(read_table(spark, sf_dir, "documents"))
