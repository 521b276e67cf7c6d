"""Toxicity: restored texts against all readings one by one, whole results against plain Python, and held-out accuracy."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.llm import toxicity as T

SF = "/root/testdata/sf0.01"
BAD = ["idiot", "stupid", "worthless", "scum"]
GOOD = ["river", "green", "little", "account", "window", "seven", "butter", "harbour", "unless", "morning"]
DISGUISES = ["1d10t", "$tup1d", "w0rthle$$", "s c u m", "i.d.i.o.t", "stuuuupid", "i-d-i-o-t", "5tup!d", "s_c_u_m"]


def prose(n, seed, bad=0):
    rng = random.Random(seed)
    words = [rng.choice(GOOD) for _ in range(n)]
    for _ in range(bad):
        words[rng.randrange(n)] = rng.choice(BAD)
    return " ".join(words)


ROWS = [(k, prose(40, k, 3 if k % 5 == 0 else 0), int(k % 5 == 0)) for k in range(400)]
ODD = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "$$$ !!! ###"), (None, "idiot"), (1004, prose(200_000, 1)), (1004, "river idiot scum"), (1005, "Ünïcode 🙂 текст ​ x"), *[(2000 + k, f"river {d} green") for k, d in enumerate(DISGUISES)]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t, _ in ROWS] + ODD + ODD[:1]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.withColumns({c: F.lit(k) for k, c in enumerate(("toxic", "curve", "words", "_id", "score", "n", "cell", "held_out"))})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, y) for i, _, y in ROWS] + [(None, 1), (1001, None), (1002, 7)]
    return spark.createDataFrame(rows, "doc_id long, toxic int").withColumn("text", F.lit("x"))


@pytest.fixture(scope="module")
def model(docs):
    return T.language_model(T.count_characters(docs))


def restored(model, text):
    data = text.encode()
    codes, s, e, _ = T.Restorer(model).words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    letters = " abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))) + "?#."
    return ["".join(letters[c] for c in codes[a:b]) for a, b in zip(s, e, strict=True)]


@pytest.mark.parametrize("text", DISGUISES)
def test_restores_disguised_words(model, text):
    assert restored(model, f"river {text} green")[1:-1] in [[w] for w in BAD]


def test_leaves_plain_words_alone(model):
    assert restored(model, "A little butter, the account; (unless) 12345 seven!") == ["a", "little", "butter", "the", "account", "unless", "#####", "seven"]


def test_viterbi_finds_the_best_of_all_readings(model):
    """Every combination of readings of short units, weighed anew."""
    rng = random.Random(3)
    table = model.tolist()
    for _ in range(150):
        raw = bytes(rng.choice(b"aabo01$.t s") for _ in range(rng.randint(1, 7)))
        best = -math.inf
        for way in itertools.product(*T.readings(raw)):
            codes = [0, 0, *[c for c, _ in way if c >= 0], 0]
            best = max(best, sum(cost for _, cost in way) + sum(table[(a << 12) | (b << 6) | c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)))
        found = [0, 0, *T.decode(raw, table), 0]
        own = sum(table[(a << 12) | (b << 6) | c] for a, b, c in zip(found, found[1:], found[2:], strict=False))
        assert any(abs(own + sum(x for _, x in way) - best) < 1e-3 for way in itertools.product(*T.readings(raw)) if [c for c, _ in way if c >= 0] == found[2:-1])


def test_language_model_counts(spark, model):
    """The trigrams of all texts by a dictionary."""
    texts = ["ab 1", "", "a  b\n", "ß?", None, " x"]
    want = Counter()
    for t in texts:
        seen = [0, *[{"a": 1, "b": 2, "x": 24, "1": T.DIGIT, "ß": 27, "?": T.SIGN}.get(c, 0) for c in t or ""], 0]
        seen = [c for k, c in enumerate(seen) if c or not k or seen[k - 1]]
        want.update((a << 12) | (b << 6) | c for a, b, c in zip(seen, seen[1:], seen[2:], strict=False))
    for parts in (1, 4):
        rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
        assert {r["cell"]: r["n"] for r in T.count_characters(rows).collect()} == dict(want)
    assert np.allclose(np.exp(model.astype(float)).reshape(-1, 64).sum(axis=1).max(), 1, atol=1e-3)


def test_all_rows_have_scores(docs, labels):
    got = T.toxicity(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in [(i, t) for i, t, _ in ROWS] + ODD + ODD[:1])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    by = {(r["doc_id"]): r for r in got}
    assert all(by[i]["predicted"] == y for i, _, y in ROWS if by[i]["held_out"])
    assert sum(by[i]["held_out"] for i, _, _ in ROWS) > 50
    nothing = {by[k]["score"] for k in (1000, 1001, 1002, 1003)}
    assert len(nothing) == 1 and nothing.pop() < 0.3
    assert all(by[2000 + k]["predicted"] == 1 for k in range(len(DISGUISES)))
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]


def test_without_labels_of_both_kinds(docs, labels):
    got = T.toxicity(docs.limit(30), labels.where("toxic = 0")).select("score").distinct().collect()
    assert len(got) == 1 and got[0][0] < 0.3
    assert T.toxicity(docs.limit(5), labels.where("false")).count() == 5
    assert T.toxicity(docs.where("false"), labels).count() == 0


def test_pieces_of_long_texts():
    """Pieces hold whole words where there are blanks, whole characters anywhere, and all bytes."""
    texts = ["ab " * 50, "", None, "é" * 100, "x", "word " * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    found = {}
    for rows, buf, off in T.pieces(batch, limit=31):
        for row, a, b in zip(rows.tolist(), off[:-1], off[1:], strict=True):
            piece = buf[a:b].tobytes().decode()
            assert len(piece.encode()) <= 31
            found[row] = found.get(row, "") + piece
            assert texts[row] is None or row != 0 or re.fullmatch(r"(ab )*", piece)
    assert [found.get(k, "") for k in range(len(texts))] == [t or "" for t in texts]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = T.op11(spark, SF).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got)
    caught = sum(r["predicted"] for r in got if r["toxic"])
    assert right >= 0.9 * len(got) and caught >= 0.7 * sum(r["toxic"] for r in got)
    assert docs.count() == T.op11(spark, SF).count()
