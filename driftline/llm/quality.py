"""Operator 5: regularised quadratic discriminant on document statistics.

Statistics of the whole text are transformed (logarithms and square roots) to
be nearer to normal. Each class has a mean and a covariance, shrunk towards
the pooled covariance and that towards a multiple of the identity; the
moments are sums that Spark gathers over all labelled rows. The score is the
posterior of class 1 from the difference of the classes' log densities:
Mahalanobis distances by products with the inverses of the Cholesky factors,
which are computed once when the model is made and kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import giving_back, keep_rows, read_table, slices, small_batches, stage, text_buffer
from driftline.llm.hashing import IS_SPACE, LOWER_BYTES, U64, span_hashes, word_hashes

FEATURES = (
    "log_bytes", "log_words", "upper", "digit", "sign", "mark", "bar", "high", "space", "log_lines", "line_length",
    "word_length", "word_spread", "distinct_words", "top_word", "pair_repeats", "line_repeats", "byte_entropy", "short_words", "end_signs",
)
#: Weight of the pooled covariance in a class's, and of the identity in the pooled one.
TO_POOLED, TO_IDENTITY = 0.3, 0.05
#: Distances are divided by this before they become a probability: densities of many statistics are overconfident.
TEMPERATURE = 4.0
THRESHOLD = 0.3

_UPPER, _DIGIT, _SIGN, _MARK, _BAR, _HIGH, _SPACE, _NEWLINE = range(1, 9)


def _byte_kinds() -> np.ndarray:
    kind = np.zeros(256, np.int64)
    kind[65:91] = _UPPER
    kind[48:58] = _DIGIT
    kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _SIGN
    kind[[ord(c) for c in "!?"]] = _MARK
    kind[[ord(c) for c in "|#$%&*@{}<>[]=\\^~_+"]] = _BAR
    kind[128:] = _HIGH
    kind[IS_SPACE] = _SPACE
    kind[10] = _NEWLINE
    return kind


_KIND = _byte_kinds()


def _runs(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: distinct keys, and the count of its commonest."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]))
    most = np.zeros(n)
    np.maximum.at(most, d[first], np.diff(np.append(first, len(k))))
    return np.bincount(d[first], minlength=n).astype(float), most


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty text's are those of no bytes, words and lines."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    doc = np.repeat(np.arange(n), np.diff(off))
    kinds = np.bincount(doc * 9 + _KIND[buf], minlength=9 * n).reshape(n, 9).astype(float)
    part = lambda k: np.sqrt(kinds[:, k] / np.maximum(size, 1))
    counts = np.bincount(doc * 256 + buf, minlength=256 * n).reshape(n, 256) / np.maximum(size, 1)[:, None]
    entropy = -(counts * np.log2(np.maximum(counts, 1e-12))).sum(axis=1)
    words, at = word_hashes(buf, off)
    number = np.diff(at).astype(float)
    owner = np.repeat(np.arange(n), np.diff(at))
    solid = ~IS_SPACE[buf]
    first = solid.copy()
    if len(buf):
        first[1:] &= ~solid[:-1]
        begins = off[:-1][np.diff(off) > 0]
        first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    long = np.add.reduceat(solid.astype(np.int64), starts).astype(float) if len(starts) else np.zeros(0)
    some = np.maximum(number, 1)
    mean = np.bincount(owner, weights=long, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, weights=long**2, minlength=n) / some - mean**2, 0))
    short = np.bincount(owner, weights=long <= 3, minlength=n) / some
    tail = starts + long.astype(np.int64) - 1
    ends = np.bincount(owner, weights=np.isin(_KIND[buf[tail]], (_SIGN, _MARK, _BAR)), minlength=n) / some if len(starts) else np.zeros(n)
    distinct, top = _runs(words, owner, n)
    same = owner[1:] == owner[:-1]
    pairs, pair_owner = (words[1:] * U64(0x9E3779B97F4A7C15) + words[:-1])[same], owner[1:][same]
    different, _ = _runs(pairs, pair_owner, n)
    paired = np.maximum(number - 1, 1)
    breaks = np.zeros(len(buf), bool)
    if len(buf):
        breaks[1:] = buf[:-1] == 10
        breaks[off[:-1][np.diff(off) > 0]] = True
    line_at = np.flatnonzero(breaks)
    line_owner = doc[line_at] if len(buf) else np.zeros(0, np.int64)
    lines = np.bincount(line_owner, minlength=n).astype(float)
    line_end = np.append(line_at[1:], len(buf))
    line_end -= buf[line_end - 1] == 10 if len(line_at) else 0
    unlike, _ = _runs(span_hashes(LOWER_BYTES[buf], line_at, line_end), line_owner, n) if len(line_at) else (np.zeros(n), None)
    many = np.maximum(lines, 1)
    out = np.stack([
        np.log1p(size), np.log1p(number), part(_UPPER), part(_DIGIT), part(_SIGN), part(_MARK), part(_BAR), part(_HIGH), part(_SPACE) + part(_NEWLINE), np.log1p(lines), np.log1p(size / many),
        np.log1p(mean), np.log1p(spread), distinct / some, np.sqrt(top / some), np.sqrt(np.maximum(number - 1 - different, 0) / paired), np.sqrt((lines - unlike) / many), entropy, short, np.sqrt(ends),
    ], axis=1)
    return out


def document_statistics(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, also, features ARRAY<DOUBLE>) of every row of docs (doc_id, text, also); a null text is empty."""
    held = ("doc_id", *also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                x = statistics(*text_buffer(piece.column("text")))
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in held], values], [*held, "features"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in held)
    return docs.select(*held, "text").mapInArrow(giving_back(run), f"{kinds}, features array<double>")


@dataclass(frozen=True)
class Discriminant:
    center: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    whiteners: tuple[np.ndarray, np.ndarray]  # inverse Cholesky factors
    log_dets: tuple[float, float]
    prior: float
    temperature: float = TEMPERATURE

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1, from 0 to 1; without both classes in training, the prior."""
        z = (x - self.center) / self.scale
        density = [-0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) - 0.5 * d for m, w, d in zip(self.means, self.whiteners, self.log_dets, strict=True)]
        odds = (density[1] - density[0]) / self.temperature + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(labelled: DataFrame, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """labelled: (features, label 0 or 1). Rows with another or a null label are left out."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(FEATURES)
        sums = np.zeros((2, 1 + width, 1 + width))
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, width)
            y = batch.column("label").to_numpy()
            for c in (0, 1):
                rows = np.concatenate([np.ones((int((y == c).sum()), 1)), x[y == c]], axis=1)
                sums[c] += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([s.reshape(-1).tolist() for s in sums], pa.list_(pa.float64()))], ["label", "sums"])

    width = len(FEATURES)
    parts = labelled.where("label in (0, 1)").select("features", F.col("label").cast("int").alias("label")).mapInArrow(giving_back(moments), "label int, sums array<double>")
    cells = parts.select("label", F.posexplode("sums").alias("cell", "value")).groupBy("label", "cell").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros((2, (1 + width) ** 2))
    for r in cells:
        sums[r["label"], r["cell"]] = r["value"]
    sums = sums.reshape(2, 1 + width, 1 + width)
    count = sums[:, 0, 0]
    total = sums.sum(axis=0)
    n = max(total[0, 0], 1)
    center = total[0, 1:] / n
    scale = np.sqrt(np.maximum(np.diag(total)[1:] / n - center**2, 1e-6))
    means, covariances = [], []
    for c in (0, 1):
        m = sums[c, 0, 1:] / max(count[c], 1) if count[c] else center
        cov = sums[c, 1:, 1:] / max(count[c], 1) - np.outer(m, m) if count[c] else np.zeros((width, width))
        means.append((m - center) / scale)
        covariances.append(cov / np.outer(scale, scale))
    pooled = (count[0] * covariances[0] + count[1] * covariances[1]) / n
    pooled = (1 - to_identity) * pooled + to_identity * max(np.trace(pooled) / width, 1e-3) * np.eye(width)
    whiteners, dets = [], []
    for c in (0, 1):
        own = to_pooled if count[c] > 1 else 1.0
        factor = np.linalg.cholesky((1 - own) * covariances[c] + own * pooled)
        whiteners.append(np.linalg.inv(factor))
        dets.append(2 * float(np.log(np.diag(factor)).sum()))
    return Discriminant(center, scale, tuple(means), tuple(whiteners), tuple(dets), float((count[1] + 1) / (count.sum() + 2)))


def held_out() -> Column:
    """Rows kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, also, held_out, score, predicted) of every row of docs (doc_id, text, also), learnt from labels (doc_id, quality).

    Learns only from rows whose crc32(doc_id as text) mod 5 is not 0, all of
    them, and only from the text. Null texts count as empty and are scored
    like any other. A null doc_id is not held out and has no label; a label
    that is null or repeats differently counts as often as it stands. An
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    stats = stage(document_statistics(docs, also), "statistics").withColumn("held_out", held_out())
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    model = fit(stats.where("not held_out").join(marks, F.col("doc_id") == F.col("_id")))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = ["doc_id", *also, "held_out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = held.value.score(batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *also))
    return stats.select(*kept, "features").mapInArrow(giving_back(run), f"{kinds}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that classify rejects; columns and types are those of docs, whatever their names.

    Each row is judged by its own text: rows that repeat a doc_id with other
    texts, and rows without one, stay or go on their own; null and empty texts
    are judged like any other. An empty table stays empty.
    """
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    named = docs.select("doc_id", "text", key.alias("_row"))
    bad = stage(classify(named, labels, threshold, ("_row",)).where("predicted = 0").select("doc_id", "_row").distinct(), "rejected")
    return keep_rows(docs, bad, bad.count(), key, "left_anti")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
