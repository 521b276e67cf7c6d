"""Links and their numbers against brute force, where shingles are frequent and where they are not."""

from collections import Counter

import numpy as np
import pytest

from driftline.llm import jaccard_join
from tests.llm.test_edges import words
from tests.llm.test_exact_ids import morse


def brute(rows, percent=80):
    """(doc_id, set size, component, links to other sets) of every row."""
    sets = {d: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for d, t in rows}
    ids = sorted(sets)
    up = {d: d for d in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    near = {d: set() for d in ids}
    for a, i in enumerate(ids):
        for j in ids[:a]:
            both = len(sets[i] & sets[j])
            if sets[i] and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                near[i].add(sets[j])
                near[j].add(sets[i])
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return Counter((d, len(sets[d]), find(d), len(near[d] - {sets[d]})) for d in ids)


def found(spark, rows):
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got)


def mixed(seed, base_words=60, copies=120):
    """Copies of a few texts with 0 to 25 % of their words changed, cut, or put behind each other."""
    rng = np.random.default_rng(seed)
    bases = [[f"b{k}_{x}" for x in rng.integers(0, 400, base_words)] for k in range(4)]
    rows = []
    for d in range(copies):
        w = list(bases[rng.integers(0, 4) if d % 3 else 0])
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(0, len(w))] = f"n{d}_{rng.integers(0, 9)}"
        if d % 5 == 0:
            w = w[: rng.integers(3, len(w))]
        if d % 7 == 0:
            w += [f"tail{d % 14}_{k}" for k in range(rng.integers(0, 25))]
        rows.append((d, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_links_of_groups_with_frequent_shingles(spark, seed):
    rows = mixed(seed)
    assert found(spark, rows) == brute(rows)


def test_links_when_every_shingle_is_taken_for_a_frequent_one(spark, monkeypatch):
    """Bit tables that are full change the way, not the result."""
    monkeypatch.setattr(jaccard_join, "_frequent", lambda table: [np.full(1 << 17, 255, np.uint8) for _ in jaccard_join.FREQUENT])
    rows = mixed(9)
    assert found(spark, rows) == brute(rows)


def test_unlike_documents_that_share_most_of_their_words(spark):
    """Boilerplate of 83 of 100 words in 5000 documents: no link, no family; and near copies among them."""
    boiler = [f"boiler{k}" for k in range(87)]
    rows = [(d, " ".join([*boiler, *[f"own{d}_{k}" for k in range(17)]])) for d in range(5000)]
    near = [(10_000 + k, rows[k][1] + " more") for k in range(0, 5000, 500)]
    got = found(spark, rows + near)
    want = Counter({(d, 100, d, 0): 1 for d in range(5000)})
    for d, _ in near:
        k = d - 10_000
        want[k, 100, k, 0] = 0
        want[k, 100, k, 1] = want[d, 101, k, 1] = 1
    assert got == +want


def test_words_that_a_polynomial_hash_takes_for_equal(spark):
    rest = " ".join(f"r{k}" for k in range(4))
    rows = [(k, f"{morse(2048, k)} {rest}") for k in (0, 1)]
    assert found(spark, rows) == brute(rows) == Counter({(0, 1, 0, 0): 1, (1, 1, 1, 0): 1})


def test_tables_are_sized_by_what_they_hold(spark):
    """All frequent shingles are told, few others are, and more of them make larger tables."""
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 60_000))
    df = np.where(np.arange(len(keys)) % 100 == 0, 300, 20)
    table = spark.createDataFrame(__import__("pandas").DataFrame({"bucket": keys, "df": df}))
    tables = jaccard_join._frequent(table)
    assert 8 * len(tables[0]) >= 8 * len(keys) > 8 * len(tables[1]) / 4 and len(tables[2]) == 1 << 15
    shingles = keys.astype(np.uint64) << np.uint64(16)
    levels = jaccard_join._levels(shingles, tables)
    assert (levels >= np.where(df > 256, 2, 1)).all() and (levels == np.where(df > 256, 2, 1)).mean() > 0.9
    others = np.random.default_rng(2).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert (jaccard_join._levels(others, tables) > 0).mean() < 0.15
