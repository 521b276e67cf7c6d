"""Vectorised hashing of the words of whole texts.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased;
equal words have equal 64-bit values in every process and on every machine.
All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_MASK = (1 << 64) - 1
_STEP = U64(0x9E3779B97F4A7C15)
_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], U64))[0])


LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
IS_SPACE = np.isin(np.arange(256), _SEPARATORS)


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf, zeros beyond its end, as one integer a place."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


#: Of the eight bytes of a lane, the first k.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
#: Longer spans are hashed and compared one by one.
_LONG = 512


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of buf[s:e] for each span, wherever it stands.

    Eight bytes at a time are mixed into what has been mixed already, from the
    length on; spans of equal length up to eight bytes never meet.
    """
    n = ends - starts
    out = mix(n.astype(U64) * _STEP + U64(0x6A09E667))
    if not len(n):
        return out
    words = lanes(buf)
    live = np.flatnonzero((n > 0) & (n <= _LONG))
    at = starts[live]
    left = n[live]
    while len(live):
        block = words[at] & _FIRST[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ (block * _STEP)) + U64(0x3C6EF372))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(n > _LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]].tobytes())
    return out


def unlike(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The places of the spans whose bytes are not those of the span others names for each."""
    n = ends - starts
    differs = n != n[others]
    words = lanes(buf)
    live = np.flatnonzero(~differs & (others != np.arange(len(n))) & (n > 0) & (n <= _LONG))
    at, to, left = starts[live], starts[others[live]], n[live]
    while len(live):
        wrong = (words[at] ^ words[to]) & _FIRST[np.minimum(left, 8)] != 0
        differs[live[wrong]] = True
        more = ~wrong & (left > 8)
        live, at, to, left = live[more], at[more] + 8, to[more] + 8, left[more] - 8
    for k in np.flatnonzero(~differs & (n > _LONG)).tolist():
        s = starts[others[k]]
        differs[k] = not np.array_equal(buf[starts[k] : ends[k]], buf[s : s + n[k]])
    return np.flatnonzero(differs)


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct span, and which of them each span equals; every byte is compared."""
    _, lead, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    other = unlike(buf, starts, ends, lead[which]) if len(lead) else lead
    which[other] = len(lead) + np.arange(len(other))
    return np.concatenate([lead, other]), which


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offsets of each text's words among them."""
    if not len(buf):
        return np.empty(0, U64), np.zeros(len(off), np.int64)
    space = IS_SPACE[buf]
    first = ~space
    first[1:] &= space[:-1]
    begins = off[:-1][off[:-1] < off[1:]]
    first[begins] = ~space[begins]
    last = ~space
    last[:-1] &= space[1:]
    stops = off[1:][off[:-1] < off[1:]] - 1
    last[stops] = ~space[stops]
    starts = np.flatnonzero(first)
    return span_hashes(LOWER_BYTES[buf], starts, np.flatnonzero(last) + 1), np.searchsorted(starts, off)


def _follow(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix((before ^ (word * _STEP)) + U64(0x3C6EF372))


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingle hashes, and the offsets of each text's among them.

    A shingle is width consecutive words; a text of fewer words is one
    shingle; a text without words has none.
    """
    words, at = word_hashes(buf, off)
    counts = np.diff(at)
    docs = np.repeat(np.arange(len(counts)), counts)
    value = np.zeros(len(words), U64)
    full = np.zeros(len(words), bool)
    if len(words) >= width:
        last = _follow(np.full(len(words) - width + 1, U64(width)), words[: len(words) - width + 1])
        for j in range(1, width):
            last = _follow(last, words[j : len(words) - width + 1 + j])
        value[: len(last)] = last
        full[: len(last)] = docs[: len(last)] == docs[width - 1 :]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        made = counts[few].astype(U64)
        for j in range(width - 1):
            some = counts[few] > j
            made[some] = _follow(made[some], words[at[:-1][few[some]] + j])
        value[at[:-1][few]], full[at[:-1][few]] = made, True
    value, docs = value[full], docs[full]
    ends = np.cumsum(np.bincount(docs, minlength=len(counts))) if len(docs) else np.zeros(len(counts), np.int64)
    out, sizes, start = [], np.zeros(len(counts), np.int64), 0
    for d, end in enumerate(ends.tolist()):
        if end > start:
            mine = np.unique(value[start:end])
            out.append(mine)
            sizes[d] = len(mine)
        start = end
    return np.concatenate(out) if out else np.empty(0, U64), np.concatenate([[0], np.cumsum(sizes)])
