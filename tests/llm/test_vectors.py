"""Clusters and codes of vectors against plain Python from their definitions, and the heaps against full searches."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftline.llm import heap_codes, lloyd

SCHEMA = "vec_id long, embedding array<float>, label int, v int, n long, cluster string, _label int, h string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, e, c, 1, 2, "x", 3, "y") for i, e, c in rows], SCHEMA).repartition(parts)


def random_rows(n, size, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    return [(k, [float(x) for x in (rng.normal(size=size) * spread).astype(np.float32)], int(rng.integers(4))) for k in range(n)]


ODD = [(None, [0.5] * 64, None), (900, None, 1), (901, [0.1] * 63 + [None], 1), (902, [float("nan")] + [0.0] * 63, 1), (903, [float("inf")] * 64, 2), (904, [1.0] * 63, 2), (905, [], 2), (7, [0.25] * 64, 3), (7, [0.25] * 64, 3), (7, [-0.25] * 64, None)]


def finite(e):
    return e is not None and all(x is not None and np.isfinite(x) for x in e)


def plain_lloyd(rows, clusters, rounds):
    kept = [(i, np.floor(64 * np.array(e, float)).astype(int)) for i, e, _ in rows if finite(e) and len(e) == 64]
    start = sorted((i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest(), v.tolist()) for i, v in kept)[:clusters]
    centers = [v for *_, v in start]
    near = lambda v: min((sum((int(a) - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centers))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[near(v)[1]].append(v)
        centers = [[sum(int(v[i]) for v in held[k]) // len(held[k]) for i in range(64)] if held[k] else c for k, c in enumerate(centers)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    inertia = Counter()
    for _, k, d in found:
        inertia[k] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, k, d, inertia[k], sum(inertia.values()), name[k]) for i, k, d in found)


@pytest.mark.parametrize("rows", [random_rows(150, 64, 1) + ODD, random_rows(5, 64, 2), [(k, [0.0] * 64, 0) for k in range(30)], ODD[:3]])
def test_lloyd(spark, rows):
    got = lloyd.lloyd(table(spark, rows), 6, 3).collect()
    assert Counter(map(tuple, got)) == plain_lloyd(rows, 6, 3)


def test_large_ids_beside_nulls(spark):
    rows = [(2**62 + 1, [0.5] * 64, 0), (None, [0.1] * 64, 0)]
    assert {r["vec_id"] for r in lloyd.lloyd(table(spark, rows), 2, 1).collect()} == {2**62 + 1, None}


def test_nothing_to_cluster_or_code(spark):
    empty = table(spark, random_rows(3, 64, 1)).where("false")
    assert lloyd.lloyd(empty).collect() == [] == heap_codes.vector_codes(empty).collect()


def test_a_component_out_of_range_raises(spark):
    with pytest.raises(Exception, match="not within"):
        lloyd.lloyd(table(spark, [(1, [1e30] * 64, 0)])).collect()


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, np.floor(1024 * np.array(e, float)).astype(int), c) for i, e, c in rows if finite(e)]
    able = sorted((i is None, i or 0, v.tolist()) for i, v, _ in kept if len(v) and len(v) % parts == 0)
    if not able:
        return Counter((i, None, None, None, hashlib.sha256(b"").hexdigest()) for i, _, _ in kept)
    size = len(able[0][2])
    same = [(i, v, c) for i, v, c in kept if len(v) == size]
    w = size // parts
    first = sorted((i is None, i or 0, v.tolist()) for i, v, _ in same)[:entries]
    books = [[np.array(v[p * w : (p + 1) * w]) for *_, v in first] for p in range(parts)]
    near = lambda v, p: min((int(((v[p * w : (p + 1) * w] - e) ** 2).sum()), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        after = []
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in same:
                held[near(v, p)[1]].append(v[p * w : (p + 1) * w])
            after.append([sum(held[k]) // len(held[k]) if held[k] else e for k, e in enumerate(books[p])])
        books = after
    name = hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], Counter()
    for i, v, c in kept:
        if len(v) == size:
            found = [near(v, p) for p in range(parts)]
            out.append((i, c, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
            sums[c] += out[-1][3]
        else:
            out.append((i, c, None, None))
    with_error = {c for _, c, _, e in out if e is not None}
    return Counter((i, code, e, sums[c] if c in with_error else None, name) for i, c, code, e in out)


@pytest.mark.parametrize("rows", [random_rows(200, 16, 3) + [(i, e and e[:16], c) for i, e, c in ODD], random_rows(200, 8, 5, 0.01), random_rows(6, 16, 4), [(k, [0.5] * 8, k % 2) for k in range(40)], [(1, [0.1] * 6, 0), (2, [0.2] * 4, 1), (None, [0.3] * 8, None)], [(None, [0.1] * 8, 1), (3, [0.5] * 7, 2)]])
def test_codes(spark, rows):
    got = heap_codes.vector_codes(table(spark, rows), 4, 12, 4).collect()
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == plain_codes(rows, 4, 12, 4)


def test_heaps_search_few_parts_anew_and_miss_none():
    """Groups far apart, whose entries settle: later rounds search few parts, and every part has the entry that a full search finds."""
    rng = np.random.default_rng(9)
    centers = rng.integers(-4000, 4000, (16, 8))
    x = centers[rng.integers(0, 16, 3000)] + rng.integers(-60, 60, (3000, 8))
    books = heap_codes.Codebooks(x[:24].reshape(24, 2, 4).transpose(1, 0, 2), np.zeros((2, 24)))
    heaps, searched = [], []
    for part in range(2):
        best, slack = heap_codes.search(x[:, part * 4 : part * 4 + 4], books.entries[part])
        heaps.append(heap_codes.Heaps.of(best, slack, 24))
    for _ in range(8):
        entries = books.entries.copy()
        for part in range(2):
            found = heaps[part].assigned()
            for k in range(24):
                if (found == k).any():
                    entries[part, k] = x[found == k, part * 4 : part * 4 + 4].sum(axis=0) // (found == k).sum()
        books = books.moved_to(entries)
        searched.append(heap_codes.update(x, heaps, books, None))
        for part in range(2):
            assert (heaps[part].assigned() == heap_codes.distances(x[:, part * 4 : part * 4 + 4], books.entries[part]).argmin(axis=1)).all()
        heaps = [heap_codes.Heaps(24, *h.flat()) for h in heaps]
    assert searched[-1] < 3000, searched


def test_rounds_search_less(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(8, 16))
    rows = [(k, [float(v) for v in centers[k % 8] + 0.02 * rng.normal(size=16)], 0) for k in range(400)]
    kept = lloyd.vectors(table(spark, rows), None, 1024, "label")
    first = np.array([r["v"] for r in kept.orderBy("vec_id").limit(8).collect()]).reshape(8, 4, 4).transpose(1, 0, 2)
    *_, searched = heap_codes.learn(kept, first, 4)
    assert searched[0] == 1600 and searched[-1] < 400


def test_distances_are_exact_for_large_numbers():
    x, e = np.array([[2**24 - 1, -(2**24)]]), np.array([[-(2**24), 2**24 - 1], [0, 0]])
    assert heap_codes.distances(x, e).tolist() == [[2 * (2**25 - 1) ** 2, (2**24 - 1) ** 2 + 2**48]]
