"""The digests against a slow version written from the definition, and the likeness of texts of all lengths."""

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import digest
from driftline.llm.hashing import span_hashes
from tests.llm.test_edges import ROWS, docs, empty  # noqa: F401

W = digest.WINDOW


def slow_entropy(window: bytes) -> int:
    """In steps, with the logarithms rounded as the operator rounds them."""
    cost = lambda c: round(4096 * c * math.log2(c))
    return digest.BINS - sum(cost(c) for c in Counter(window).values()) * digest.BINS // cost(W)


def slow_windows(text: str, width: int = W) -> list[bytes]:
    raw = text.encode()
    return [raw[k : k + width] for k in range(len(raw) - width + 1)]


def slow_ranks(texts: list[str]) -> dict[int, int]:
    counts = Counter(slow_entropy(w) for t in texts for w in slow_windows(t))
    order = sorted(range(digest.BINS + 1), key=lambda b: (b < digest.DULL, counts[b] if b >= digest.DULL else -b, b))
    return {b: k for k, b in enumerate(order)}


def slow_chain(windows: list[bytes]) -> bytes:
    names: list[int] = []
    for w in windows:
        h = int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
        if h not in names:
            names.append(h)
    out = b""
    for k in range(0, len(names), digest.FILTER_FEATURES):
        bits = np.zeros(digest.FILTER_BITS, bool)
        for h in names[k : k + digest.FILTER_FEATURES]:
            for j in range(digest.HASHES):
                bits[h >> (11 * j) & (digest.FILTER_BITS - 1)] = True
        out += np.packbits(bits).tobytes()
    return out


def slow_fingerprint(text: str, ranks: dict[int, int]) -> str:
    windows = slow_windows(text)
    if len(windows) > digest.FILTER_FEATURES:
        rank = [ranks[slow_entropy(w)] for w in windows]
        votes = Counter(min(range(k, k + W), key=lambda i: (rank[i], i)) for k in range(len(windows) - W + 1))
        chosen = {k for k, n in votes.items() if n >= W // digest.POPULAR} or set(votes)
        windows = [windows[k] for k in sorted(chosen)]
    n = len(text.encode())
    chains = [(w, slow_windows(text, w)) for w in digest.WIDTHS if w <= n < digest.NARROW * w] + [(W, windows)]
    return ";".join(f"{w}:{base64.b64encode(slow_chain(x)).decode()}" for w, x in chains if x)


def test_digests_by_definition(docs):  # noqa: F811
    """Every row and column, repeated rows and rows without an id among them."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    ranks = slow_ranks([r["text"] for r in rows])
    want = Counter()
    for k, r in enumerate(rows):
        following = rows[(k + 1) % len(rows)]["text"]
        third = len(r["text"]) // 3
        changed = r["text"][: len(r["text"]) - third] + following[:third]
        own, new, other = (slow_fingerprint(t, ranks) for t in (r["text"], changed, following))
        near = [round(digest.likeness(digest.parsed(own), digest.parsed(x)), 9) for x in (new, other)]
        want[r["doc_id"], len(r["text"]), hashlib.sha256(changed.encode()).hexdigest(), own, new, *near] += 1
    got = digest.digest_documents(docs).collect()
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")
    assert Counter((*[r[c] for c in names], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    assert len(rows) == len(ROWS)


def text(n: int, seed: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))[:n]


RANKS = digest.rarity(np.ones(digest.BINS + 1, np.int64))


def near(a: str, b: str) -> float:
    x, y = digest.fingerprints([a, b], RANKS)
    assert digest.likeness(x, y) == digest.likeness(digest.parsed(digest.written(x)), digest.parsed(digest.written(y)))
    return digest.likeness(x, y)


@pytest.mark.parametrize("short", [0, 9, 1000])
def test_what_keeps_two_thirds_is_like(short):
    """Texts of 1 to 300 characters, edited by an empty, a short and a long text."""
    for n in range(1, 301):
        whole = text(n, n)
        assert near(whole, digest.edited(whole, text(short, n + 1000))) > 0.25, n


def test_two_thirds_kept_are_a_half_alike_or_more():
    found = [near(whole, digest.edited(whole, text(300, n + 1000))) for n in range(10, 2000, 7) for whole in [text(n, n)]]
    assert sum(x >= 0.5 for x in found) > 0.9 * len(found) and sum(found) / len(found) < 0.75


def test_unlike_texts_are_not_like():
    found = [near(text(n, n), text(m, 5000 + n)) for n in range(3, 301, 3) for m in (n, n + 50)]
    assert max(found) < 0.55 and sum(found) / len(found) < 0.05


@pytest.mark.parametrize("shared", ["The company ", "In other words, the ", "A"])
@pytest.mark.parametrize("at_the_end", [False, True])
def test_a_shared_opening_or_ending_counts_as_what_it_is(shared, at_the_end):
    """Texts of 20 to 300 characters more: on average no more alike than the shared part of them, and a tenth."""
    over = []
    for n in range(20, 301, 4):
        a, b = (x + shared if at_the_end else shared + x for x in (text(n, n), text(n, 7000 + n)))
        over.append(near(a, b) - len(shared) / len(a))
    assert sum(over) / len(over) < 0.1 and max(over) < 0.25


def test_filters_are_compared_in_blocks(monkeypatch):
    a, b = text(60_000, 1), text(30_000, 2) + text(60_000, 1)[10_000:40_000]
    whole = near(a, b)
    monkeypatch.setattr(digest, "COMPARED", 3)
    assert near(a, b) == pytest.approx(whole) and 0.3 < whole < 0.7


@pytest.mark.parametrize("n", [63, 64, 128, 256, 257])
def test_one_character_more_changes_little(n):
    whole = text(n + 1, 1)
    assert near(whole, whole[:-1]) > 0.6 and near(whole[:-1], text(n, 2)) < 0.2
