"""The search for packings against the least number of sequences, and on more lengths than a fixed number of steps reaches."""

from collections import Counter

import numpy as np
import pytest

from driftline.llm import packing


def sequences(patterns):
    return sum(n for _, n in patterns)


def least(items, capacity):
    """The best of all orders of filling, by subsets of the items."""
    best = [(0, 0)] + [(len(items) + 1, 0)] * ((1 << len(items)) - 1)
    for m in range(1, len(best)):
        for k in range(len(items)):
            if m >> k & 1:
                full, used = best[m ^ (1 << k)]
                best[m] = min(best[m], (full, used + items[k]) if full and used + items[k] <= capacity else (full + 1, items[k]))
    return best[-1][0]


@pytest.mark.parametrize("seed", range(8))
def test_small_packings_are_best(seed):
    items = np.random.default_rng(seed).integers(10, 60, 10).tolist()
    assert sequences(packing.pack_lengths(dict(Counter(items)), 100)) == least(items, 100)


def check(found, counts, capacity):
    used = Counter()
    for items, n in found:
        assert sum(items) <= capacity and n > 0
        for s in items:
            used[s] += n
    assert used == Counter(counts)
    return sequences(found)


@pytest.mark.parametrize("seed", range(30))
def test_a_search_without_a_bound_of_steps_is_best(seed):
    """Repeated lengths, many and few; the same best by all orders of filling."""
    rng = np.random.default_rng(100 + seed)
    items = rng.choice(rng.integers(8, 70, rng.integers(3, 13)), 13).tolist()
    counts = dict(Counter(items))
    assert check(packing.pack_lengths(counts, 100, None), counts, 100) == least(items, 100)


@pytest.mark.parametrize("seed", range(3))
def test_many_lengths_are_packed_better_than_by_best_fit(seed):
    counts = dict(Counter(np.random.default_rng(seed).integers(400, 1100, 3000).tolist()))
    best, bound = sequences(packing.best_fit(counts, 2048)), packing.least_sequences(counts, 2048)
    found = check(packing.pack_lengths(counts), counts, 2048)
    assert bound <= found < bound + (best - bound) / 2


def test_out_of_steps_still_packs_everything():
    counts = dict(Counter(np.random.default_rng(0).integers(1000, 4500, 4500).tolist()))
    for steps in (0, 1, 1000, 50_000):
        assert check(packing.pack_lengths(counts, 8192, steps), counts, 8192) <= sequences(packing.best_fit(counts, 8192))


def test_many_small_pieces_fill_a_sequence():
    counts = {1: 3000, 2047: 1, 2040: 2}
    assert check(packing.pack_lengths(counts, 2048), counts, 2048) == packing.least_sequences(counts, 2048)
