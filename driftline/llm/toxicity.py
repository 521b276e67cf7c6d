"""Operator 11: toxicity of texts whose words may be disguised, through a noisy channel.

A character language model (trigrams that fall back to bigrams and single
characters, counted over all documents) says what text looks like; a channel
says how a writer may have disguised a letter: by a look-alike digit or sign,
by signs or blanks put between letters, by repeating it. Every unit of a text
(a word, or single characters with a blank between each) that could be
disguised becomes a lattice of readings, and Viterbi's algorithm takes the
likeliest. The restored words and their beginnings are the features of the
score: which of them tell toxic texts is counted on labelled rows, and a
logistic curve over a text's strongest evidence gives the probability.

Texts are read in pieces of at most half a megabyte, cut at blanks, so memory
does not grow with the length of a text; what is found in the pieces of a text
is put together again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import BROADCAST_IDS, SLICE_BYTES, giving_back, read_table, small_batches, stage, text_buffer, unstage
from driftline.llm.hashing import U64, distinct_spans, mix, span_hashes

THRESHOLD = 0.3
#: Labelled rows that the score is learnt from, at most in expectation; all others are only scored.
MOST_LABELLED = 40_000
#: Of those, one in so many tells the curve and takes no part in the counts.
CURVE = 4
#: Features that may tell toxic texts: in so many toxic texts at least, of so much evidence, and so many at most (the strongest).
LEAST_TEXTS, LEAST_EVIDENCE, MOST_FEATURES = 4, 4.0, 50_000
#: Beginnings of a word that are features, in characters.
BEGINNINGS = (3, 4, 5, 6, 7, 8)

# Characters. A text's characters become one byte each (raw), letters in lower case; restored ones have codes below 64.
BLANK, OTHER, DIGIT, SIGN, SYMBOLS = 0, 60, 61, 62, 64
_HIDDEN, _FOREIGN = 1, 2  # raw bytes of characters without width, and of all beyond Latin-1
#: What a digit or sign may stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Logarithms of what the channel does: a look-alike for a letter, a digit or sign meant as such beside letters, a sign put between letters, a blank meant or put between single characters, a letter doubled, or kept and put in where there are three or more.
LOOKS, MEANT, PUT_IN, APART, SPACED, DOUBLED, STAYS, MANY = -1.5, -3.0, -3.5, -2.0, -0.5, -4.0, -3.0, -0.5
#: Characters of a unit that are decoded together.
PIECE = 64
#: Shares of trigrams, bigrams and single characters; an even share of all codes is the rest.
BLEND = (0.75, 0.2, 0.049)

_RAW = np.arange(256, dtype=np.uint8)
_RAW[65:91] += 32
_RAW[0xC0:0xDF] += 32
_RAW[0xD7] = 0xD7
_RAW[:9] = 3
_RAW[14:32] = 3
_RAW[0xAD] = _HIDDEN


def _codes() -> np.ndarray:
    out = np.full(256, SIGN, np.uint8)
    out[[0x20, *range(9, 14)]] = BLANK
    out[97:123] = np.arange(1, 27)
    out[0xDF:0x100] = np.arange(27, 60)
    out[0xF7] = SIGN
    out[_FOREIGN] = OTHER
    out[48:58] = DIGIT
    return out


CODE = _codes()
_LETTER = (CODE > 0) & (CODE <= OTHER)
_LOOKS = {ord(c): tuple(ord(x) - 96 for x in letters) for c, letters in LOOK_ALIKES.items() if ord(c) < 256}
_SEEN = np.array([k in _LOOKS for k in range(256)])


def raw_text(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each character of the UTF-8 texts, and their offsets in characters."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    out = _RAW[np.minimum(points, 255)]
    out[points > 255] = _FOREIGN
    out[(points >= 0x200B) & (points <= 0x200F) | (points == 0x2060) | (points == 0xFEFF)] = _HIDDEN
    out[points == 0x20AC] = ord("3")  # the euro sign reads like a 3
    begins = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return out, begins[off]


def pieces(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, bytes, offsets) of the batch's texts in pieces of about limit bytes; a longer text is cut after a blank if there is one, and its row number comes again."""
    buf, off = text_buffer(batch.column(name))
    blank = (CODE[:128] == BLANK).nonzero()[0]
    start = 0
    while start < len(off) - 1:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        a, b = int(off[start]), int(off[stop])
        if b - a <= limit:
            yield np.arange(start, stop), buf[a:b], off[start : stop + 1] - a
        else:  # one long text
            while a < b:
                end = min(a + limit, b)
                if end < b:
                    cut = np.flatnonzero(np.isin(buf[a:end], blank))
                    if len(cut):
                        end = a + int(cut[-1]) + 1
                    else:
                        while end > a + 1 and buf[end] & 0xC0 == 0x80:  # not within a character
                            end -= 1
                yield np.array([start]), buf[a:end], np.array([0, end - a])
                a = end
        start = stop


# The language model.


def count_characters(docs: DataFrame) -> DataFrame:
    """(cell, n) of the codes of three characters in a row, over all texts; a text begins and ends with a blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, buf, off in pieces(batch):
                raw, at = raw_text(buf, off)
                # A blank before, between and after the texts; blanks in a row count as one. What lies around an end is of two texts.
                code = np.insert(CODE[raw], at, BLANK).astype(np.int64)
                kept = np.concatenate([[True], (code[1:] != BLANK) | (code[:-1] != BLANK)])
                end = np.zeros(int(kept.sum()), bool)
                end[(np.cumsum(kept) - 1)[np.insert(np.zeros(len(raw), bool), at, True)]] = True
                code = code[kept]
                if len(code) > 2:
                    cells = (code[:-2] << 12) | (code[1:-1] << 6) | code[2:]
                    total += np.bincount(cells[~end[1:-1]], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["cell", "n"])

    return docs.select("text").mapInArrow(giving_back(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """Logarithms of the probability of each code after any two, from (cell, n): a table of 64**3 numbers."""
    found = counts.toArrow()
    n = np.zeros(SYMBOLS**3)
    n[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    share = lambda x: x / np.maximum(x.sum(axis=-1, keepdims=True), 1)
    three, two, one = share(n), share(n.sum(axis=0)), share(n.sum(axis=(0, 1)))
    a, b, c = BLEND
    return np.log(a * three + b * two + c * one + (1 - a - b - c) / SYMBOLS).astype(np.float32).reshape(-1)


# The channel.


def readings(raw: bytes) -> list[list[tuple[int, float]]]:
    """What each character of a unit may stand for, and the logarithm of how readily: (code, or -1 for nothing; cost)."""
    out: list[list[tuple[int, float]]] = []
    last, run = -1, 0
    for k, c in enumerate(raw):
        run = run + 1 if c == last else 1
        last = c
        code = int(CODE[c])
        if code == BLANK:
            out.append([(BLANK, APART), (-1, SPACED)])
        elif code <= OTHER:
            if run == 1:
                out.append([(code, 0.0)])
            elif run > 2 or raw[k + 1 : k + 2] == raw[k : k + 1]:  # one of three or more
                out.append([(code, STAYS), (-1, MANY)])
            else:
                out.append([(code, 0.0), (-1, DOUBLED)])
        else:
            some = [(code, MEANT), *[(x, LOOKS) for x in _LOOKS.get(c, ())]]
            out.append(some if code == DIGIT else [*some, (-1, PUT_IN)])
    return out


def decode(raw: bytes, model: list[float]) -> bytes:
    """The likeliest restored codes of a unit of raw bytes under the model: Viterbi over the last two restored codes. Long units are decoded in pieces."""
    if len(raw) > PIECE:
        return b"".join([decode(raw[k : k + PIECE], model) for k in range(0, len(raw), PIECE)])
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for options in readings(raw):
        reached: dict[int, tuple[float, tuple | None]] = {}
        for context, (score, path) in states.items():
            for code, cost in options:
                if code < 0:
                    to, value, way = context, score + cost, path
                else:
                    to = ((context & 63) << 6) | code
                    value, way = score + cost + model[(context << 6) | code], (code, path)
                if to not in reached or value > reached[to][0]:
                    reached[to] = (value, way)
        states = reached
    _, way = max(((score + model[context << 6], path) for context, (score, path) in states.items()), key=lambda x: x[0])
    codes = bytearray()
    while way is not None:
        codes.append(way[0])
        way = way[1]
    codes.reverse()
    return bytes(codes)


def units(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units: words without the signs at their ends, and runs of three or more single characters with a blank between each.

    One or two signs at an end that look like a letter stay. A word of signs alone is no unit.
    """
    solid = CODE[raw] != BLANK
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1]
    after = np.concatenate([solid[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    if not len(starts):
        return starts, ends
    full = np.concatenate([[0], np.cumsum((CODE[raw] != SIGN) & solid)])
    some = full[ends] > full[starts]
    lead = np.searchsorted(full, full[starts] + 1) - 1  # the first character that is no sign
    last = np.searchsorted(full, full[ends])
    looks = np.concatenate([[0], np.cumsum(_SEEN[raw])])
    lead, last = np.minimum(lead, len(raw)), np.minimum(last, len(raw))
    keep_front = (lead - starts <= 2) & (looks[lead] - looks[starts] == lead - starts)
    keep_back = (ends - last <= 2) & (looks[ends] - looks[last] == ends - last)
    a, b = np.where(keep_front, starts, lead), np.where(keep_back, ends, last)
    single = (ends - starts == 1) & (some | _SEEN[raw[starts]])
    follows = np.zeros(len(starts), bool)
    if len(starts) > 1:
        follows[1:] = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1) & ~edge[starts[1:]] & ~edge[ends[:-1]]
    head = np.flatnonzero(~follows)
    count = np.diff(np.append(head, len(starts)))
    joined = count >= 3
    in_join = np.repeat(joined, count)
    keep = some & ~in_join
    out_a = np.concatenate([a[keep], starts[head[joined]]])
    out_b = np.concatenate([b[keep], ends[head[joined] + count[joined] - 1]])
    order = np.argsort(out_a, kind="stable")
    return out_a[order], out_b[order]


def disguised(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which units have more than one reading: letters with digits, signs or blanks, or a letter twice in a row."""
    code = CODE[raw]
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    letters = total(_LETTER[raw])
    odd = total(~_LETTER[raw])
    twice = total(np.concatenate([[False], (raw[1:] == raw[:-1]) & (code[1:] > BLANK) & (code[1:] <= OTHER)]))
    inside = np.minimum(starts + 1, ends)
    return ((letters[ends] > letters[starts]) & (odd[ends] > odd[starts])) | (twice[ends] > twice[inside])


class Restorer:
    """Restores texts under a model; remembers the readings of some units."""

    KEPT = 100_000

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.tolist()
        self.known: dict[bytes, bytes] = {}

    def read(self, unit: bytes) -> bytes:
        found = self.known.get(unit)
        if found is None:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            found = self.known[unit] = decode(unit, self.model)
        return found

    def words(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, the starts and ends of the restored words in them, and which text each word is of."""
        raw, at = raw_text(buf, off)
        starts, ends = units(raw, at)
        owner = np.searchsorted(at, starts, "right") - 1
        odd = np.flatnonzero(disguised(raw, starts, ends)) if len(starts) else np.zeros(0, np.int64)
        source, begin, size = CODE[raw], starts.copy(), ends - starts
        if len(odd):
            lead, which = distinct_spans(raw, starts[odd], ends[odd])
            read = [self.read(raw[starts[k] : ends[k]].tobytes()) for k in odd[lead]]
            sizes = np.array([len(x) for x in read])
            places = len(source) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            source = np.concatenate([source, np.frombuffer(b"".join(read), np.uint8)])
            begin[odd], size[odd] = places[which], sizes[which]
        # Every unit and a blank after it; restored ones may hold several words.
        to = np.concatenate([[0], np.cumsum(size + 1)])
        codes = np.zeros(to[-1], np.uint8)
        where = np.repeat(to[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
        codes[where] = source[np.repeat(begin - to[:-1], size) + where]
        solid = codes != BLANK
        s = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]])) if len(codes) else np.zeros(0, np.int64)
        e = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1 if len(codes) else np.zeros(0, np.int64)
        return codes, s, e, owner[np.searchsorted(to, s, "right") - 1]


# Evidence.


def word_features(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row for each word: the hash of the word, and of each of its BEGINNINGS that is shorter than it (else 0)."""
    out = np.zeros((len(starts), 1 + len(BEGINNINGS)), U64)
    out[:, 0] = mix(span_hashes(codes, starts, ends) ^ U64(0x71))
    for k, size in enumerate(BEGINNINGS):
        longer = np.flatnonzero(ends - starts > size)
        out[longer, 1 + k] = mix(span_hashes(codes, starts[longer], starts[longer] + size) ^ U64(0x0B + size))
    return out


@dataclass(frozen=True)
class Evidence:
    """Features (sorted) with the strength of each and its odds (the logarithm of its rates in toxic and clean words); how much a word without any lowers the odds; the curve over a text's statistics; and the probability without a curve."""

    features: np.ndarray
    strength: np.ndarray
    odds: np.ndarray
    drop: float
    center: np.ndarray
    scale: np.ndarray
    curve: np.ndarray
    prior: float

    def of_words(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strength and odds of the strongest feature of each word; zeros: none."""
        if not len(self.features) or not len(starts):
            return np.zeros(len(starts)), np.zeros(len(starts))
        found = word_features(codes, starts, ends)
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        strength = np.where(self.features[at] == found, self.strength[at], 0.0)
        best = strength.argmax(axis=1)
        rows = np.arange(len(starts))
        top = strength[rows, best]
        return top, np.where(top > 0, self.odds[at[rows, best]], 0.0)

    def inputs(self, sums: np.ndarray) -> np.ndarray:
        """What the curve is over: the strongest evidence, the odds of all words together (their size by its logarithm), and the roots of the odds and of the words with evidence for each word."""
        words = np.maximum(sums[:, 0], 1)
        return np.stack([sums[:, 3], np.arcsinh(sums[:, 2] - self.drop * sums[:, 0]), np.sqrt(sums[:, 2] / words), np.sqrt(sums[:, 1] / words)], axis=1)

    def score(self, sums: np.ndarray) -> np.ndarray:
        if not len(self.curve):
            return np.full(len(sums), self.prior)
        z = np.concatenate([np.ones((len(sums), 1)), (self.inputs(sums) - self.center) / self.scale], axis=1)
        return 1 / (1 + np.exp(-np.clip(z @ self.curve, -500, 500)))


#: Statistics of a text that the curve is over.
STATISTICS = 4


def text_sums(strength: np.ndarray, odds: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the texts from their words: words, those with evidence, their odds; and the strongest evidence."""
    sums = [np.bincount(owner, minlength=rows), np.bincount(owner, weights=strength > 0, minlength=rows), np.bincount(owner, weights=odds, minlength=rows)]
    strongest = np.zeros(rows)
    np.maximum.at(strongest, owner, strength)
    return np.stack([*[x.astype(float) for x in sums], strongest], axis=1)


def add_pieces(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums of texts from those of their pieces."""
    return np.concatenate([a[:, :3] + b[:, :3], np.maximum(a[:, 3:], b[:, 3:])], axis=1)


def evidence_of(toxic: np.ndarray, clean: np.ndarray, toxic_texts: int, clean_texts: int) -> np.ndarray:
    """The root of the likelihood ratio of a feature that is in so many toxic and clean texts; 0 where it does not speak for toxic ones."""
    t, c, nt, nc = toxic.astype(float), clean.astype(float), max(toxic_texts, 1), max(clean_texts, 1)
    p = (t + c) / (nt + nc)

    def part(x: np.ndarray, n: int, share: np.ndarray) -> np.ndarray:
        rest = n - x
        return x * np.log(np.maximum(share, 1e-12)) + rest * np.log(np.maximum(1 - share, 1e-12))

    gain = part(t, nt, t / nt) + part(c, nc, c / nc) - part(t, nt, p) - part(c, nc, p)
    return np.where(t / nt > c / nc, np.sqrt(np.maximum(2 * gain, 0)), 0.0)


def logistic_curve(statistics: np.ndarray, toxic: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (the constant first) of the regularised logistic regression, by Newton's method."""
    center, scale = statistics.mean(axis=0), np.maximum(statistics.std(axis=0), 1e-9)
    z = np.concatenate([np.ones((len(statistics), 1)), (statistics - center) / scale], axis=1)
    keep = ridge * np.diag([0.0, *[1.0] * statistics.shape[1]])
    w = np.zeros(z.shape[1])
    w[0] = np.log((toxic.sum() + 1) / (len(toxic) - toxic.sum() + 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep + 1e-9 * np.eye(len(w)), z.T @ (toxic - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, w


# Spark.


def held_out() -> Column:
    """Rows kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, curve) of the rows to learn from: not held out, with a label 0 or 1, about most at most, chosen by a hash of doc_id. curve: whether the row tells the curve."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    there = marks.count()
    drawn = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    if there > most:
        marks = marks.where(drawn < int((1 << 30) * most / there))
    marks = marks.withColumn("curve", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(CURVE)) == 0)
    marks = F.broadcast(marks) if min(there, 2 * most) <= BROADCAST_IDS else marks
    return docs.join(marks, docs["doc_id"] == marks["_id"]).select("text", "toxic", "curve")


def restored_words(texts: DataFrame, model) -> DataFrame:
    """(toxic, curve, words BINARY) of every row: the codes of its restored words, a zero after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Restorer(model.value)
        for batch in batches:
            found: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for rows, buf, off in pieces(batch):
                codes, s, e, owner = reader.words(buf, off)
                at = np.searchsorted(owner, np.arange(len(rows) + 1))
                for k, row in enumerate(rows.tolist()):
                    if at[k + 1] > at[k]:
                        found[row].append(codes[s[at[k]] : e[at[k + 1] - 1] + 1].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("curve"), pa.array([b"".join(x) for x in found], pa.binary())], ["toxic", "curve", "words"])

    return texts.mapInArrow(giving_back(run), "toxic int, curve boolean, words binary")


def _spans(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(blob, np.uint8)
    solid = codes != BLANK
    starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes, starts, np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1 if len(codes) else starts


def _text_features(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    found, times = np.unique(word_features(*_spans(blob)), return_counts=True)
    return found[found != 0], times[found != 0]


def count_features(texts: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(feature, n, times): in how many of texts (words) each feature is and how often in all, of all or of the given sorted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            found, times = (np.concatenate([x[k] for x in held]) if held else np.zeros(0, t) for k, t in enumerate((U64, np.int64)))
            held.clear()
            features, which, n = np.unique(found, return_inverse=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(features.view(np.int64)), pa.array(n), pa.array(np.bincount(which, weights=times, minlength=len(features)).astype(np.int64))], ["feature", "n", "times"])

        for batch in batches:
            for blob in batch.column("words").to_pylist():
                mine, times = _text_features(blob)
                if only is not None:
                    keep = np.isin(mine, only, assume_unique=True)
                    mine, times = mine[keep], times[keep]
                held.append((mine, times))
                size += len(mine)
                if size > 1_000_000:
                    yield rows()
                    size = 0
        yield rows()

    return texts.select("words").mapInArrow(giving_back(run), "feature long, n long, times long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


def learn(texts: DataFrame) -> Evidence:
    """The evidence from texts (toxic, curve, words)."""
    number = {(r["toxic"], r["curve"]): r["n"] for r in texts.groupBy("toxic", "curve").agg(F.count("*").alias("n")).collect()}
    at = lambda toxic, curve: number.get((toxic, curve), 0)
    nt, nc = at(1, False), at(0, False)
    prior = (nt + at(1, True) + 1) / (sum(number.values()) + 2)
    none = np.zeros(STATISTICS)
    nothing = Evidence(np.zeros(0, U64), np.zeros(0), np.zeros(0), 0.0, none, none + 1, np.zeros(0), prior)
    if not nt or not nc or not at(1, True) or not at(0, True):
        return nothing
    toxic = count_features(texts.where("toxic = 1 and not curve")).where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "feature").limit(4 * MOST_FEATURES).toArrow()
    features = toxic.column("feature").to_numpy().view(U64)
    order = np.argsort(features)
    features = features[order]
    t, often_t = (toxic.column(c).to_numpy()[order] for c in ("n", "times"))
    clean = count_features(texts.where("toxic = 0 and not curve"), features).toArrow()
    c, often_c = np.zeros(len(features), np.int64), np.zeros(len(features), np.int64)
    where = np.searchsorted(features, clean.column("feature").to_numpy().view(U64))
    c[where], often_c[where] = clean.column("n").to_numpy(), clean.column("times").to_numpy()
    strength = evidence_of(t, c, nt, nc)
    strong = np.argsort(-strength, kind="stable")[:MOST_FEATURES]
    strong = np.sort(strong[strength[strong] >= LEAST_EVIDENCE])
    spark = texts.sparkSession
    made = replace(nothing, features=features[strong], strength=strength[strong], odds=np.zeros(len(strong)))

    def sums_of(rows: DataFrame, evidence: Evidence) -> DataFrame:
        held = spark.sparkContext.broadcast(evidence)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.zeros((batch.num_rows, STATISTICS))
                for k, blob in enumerate(batch.column("words").to_pylist()):
                    codes, s, e = _spans(blob)
                    found[k] = text_sums(*held.value.of_words(codes, s, e), np.zeros(len(s), np.int64), 1)[0]
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(x) for x in np.ascontiguousarray(found.T)]], ["toxic", *"abcd"])

        return rows.select("toxic", "words").mapInArrow(giving_back(run), "toxic int, a double, b double, c double, d double")

    total = {r["toxic"]: (r["a"], r["b"]) for r in sums_of(texts.where("not curve"), made).groupBy("toxic").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    (words_t, hits_t), (words_c, hits_c) = (total.get(k, (0.0, 0.0)) for k in (1, 0))
    words_t, words_c = max(words_t, 1.0), max(words_c, 1.0)
    odds = np.log((often_t[strong] + 0.5) / words_t) - np.log((often_c[strong] + 0.5) / words_c)
    drop = float(np.log(max(1 - hits_c / words_c, 1e-6)) - np.log(max(1 - hits_t / words_t, 1e-6)))
    made = replace(made, odds=np.maximum(odds, 0.0), drop=drop)
    rows = sums_of(texts.where("curve"), made).toArrow()  # a part of MOST_LABELLED
    x = made.inputs(np.stack([rows.column(k).to_numpy() for k in "abcd"], axis=1))
    y = rows.column("toxic").to_numpy()
    order = np.lexsort((y, *x.T))
    center, scale, curve = logistic_curve(x[order], y[order].astype(float))
    return replace(made, center=center, scale=scale, curve=curve)


def score_texts(docs: DataFrame, model, evidence, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, told = Restorer(model.value), evidence.value
        for batch in batches:
            found = np.zeros((batch.num_rows, STATISTICS))
            for rows, buf, off in pieces(batch):
                codes, s, e, owner = reader.words(buf, off)
                if len(s):
                    lead, which = distinct_spans(codes, s, e)
                    strength, odds = told.of_words(codes, s[lead], e[lead])
                    found[rows] = add_pieces(found[rows], text_sums(strength[which], odds[which], owner, len(rows)))
            p = told.score(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(giving_back(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text), learnt from labels (doc_id, toxic); other columns are ignored.

    Learns from about most rows at most whose crc32(doc_id as text) mod 4 is
    not 2, and only from their texts; the character model is counted over all
    texts, without labels. A null text counts as empty; an empty text, and one
    of signs or blanks alone, has no evidence and the score of a text without
    any. Repeated rows are scored alike and are learnt from as often as they
    stand, as are repeated labels; labels other than 0 and 1 are left out. A
    null doc_id is not held out and has no label. Without labels of both kinds
    every text has their share. Very long texts are read whole, in pieces. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    model = spark.sparkContext.broadcast(language_model(count_characters(docs)))
    texts = stage(restored_words(labelled_texts(docs, labels, most), model), "restored")
    evidence = spark.sparkContext.broadcast(learn(texts))
    unstage(texts)
    return score_texts(docs, model, evidence, threshold)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
