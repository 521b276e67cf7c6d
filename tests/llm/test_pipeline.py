"""The pipeline against plain Python, on rows with nulls, ties, repeated rows, long texts and clashing names, and on empty tables."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftline.llm import jaccard_join, line_dedup, packing, quality
from driftline.llm.common import read_table
from driftline.llm.word_tokens import default_path
from tests.llm.test_edges import LOWER, prose, words

SF = "/root/testdata/sf0.001"
STRIP = " \t\n\x0b\x0c\r"


def rows():
    base = prose(120, 50)
    good = [(k, prose(150 + k, 100 + k)) for k in range(40)]
    bad = [(k, "BUY NOW!!! $$$ " * 20 + str(k)) for k in range(40, 80)]
    shared = [(k, f"{prose(80, 300 + k)}\nTHE same footer line of words here\n  The same footer LINE of words here {'' if k % 2 else ' '}") for k in range(80, 95)]
    near = [(k, base + f" tail{k}") for k in range(95, 100)]
    odd = [(100, None), (101, ""), (102, " \n "), (103, base), (103, base), (104, prose(30_000, 9)), (None, prose(200, 77)), (40, prose(160, 500))]
    return good + bad + shared + near + odd


LABELS = [(k, int(k < 40)) for k in range(80) if k != 40]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(k) for k, c in enumerate(("_row", "_named", "_id", "h", "part", "first", "new", "component", "seats", "length", "rank", "score"))})
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    docs.where("false").write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int").write.parquet(f"{folder}/none/labels.parquet")
    return folder


def plain_scores(docs, labels):
    """The discriminant by numpy on the operator's statistics of each text."""
    x = np.concatenate([quality.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])) for _, t in docs])
    label = dict(labels)
    train = [k for k, (d, _) in enumerate(docs) if d in label and zlib.crc32(str(d).encode()) % 5]
    y = np.array([label[docs[k][0]] for k in train])
    own = x[train]
    center, scale = own.mean(axis=0), np.sqrt(np.maximum(own.var(axis=0), 1e-6))
    z, own = (x - center) / scale, (own - center) / scale
    cov = [np.cov(own[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * cov[c] for c in (0, 1))
    pooled = (1 - quality.TO_IDENTITY) * pooled + quality.TO_IDENTITY * max(np.trace(pooled) / len(pooled), 1e-3) * np.eye(len(pooled))
    logs = []
    for c in (0, 1):
        s = (1 - quality.TO_POOLED) * cov[c] + quality.TO_POOLED * pooled
        d = z - own[y == c].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    prior = (y.sum() + 1) / (len(y) + 2)
    odds = (logs[1] - logs[0]) / quality.TEMPERATURE + np.log(prior / (1 - prior))
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def plain_lines(docs):
    """Lines of ten documents or more lose all copies but the first, by doc_id (none first) and position."""
    key = lambda x: x.strip(STRIP).translate(LOWER)
    number = Counter(k for _, t in set(docs) for k in {key(x) for x in (t or "").split("\n")} if k)
    first, out = {}, {}
    for d, t in sorted(set(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, line in enumerate((t or "").split("\n")):
            if number[key(line)] >= 10:
                first.setdefault(key(line), (d, t, p))
    for d, t in set(docs):
        out[d, t] = "\n".join(x for p, x in enumerate((t or "").split("\n")) if number[key(x)] < 10 or first[key(x)] == (d, t, p))
    return [(d, out[d, t]) for d, t in docs]


def plain_near(docs):
    """Of the rows that links reach those of the least doc_id stay, and of repeated rows one; every row that links with nothing stays."""
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in docs]
    up = list(range(len(docs)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if docs[a][0] is not None and docs[b][0] is not None and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    groups = {}
    for k, (d, t) in enumerate(docs):
        groups.setdefault(find(k), []).append((d, t))
    kept = []
    for g in groups.values():
        first = {r for r in g if r[0] == min(d for d, _ in g)} if len(g) > 1 else set(g)
        assert len(first) == 1
        kept += first
    return kept


NEAR = [(1, prose(40, 1)), (2, prose(40, 1) + " more"), (2, prose(50, 2)), (3, prose(50, 2)), (3, "short"), (None, "short"), (None, "short"), (None, prose(40, 1)), (None, None), (4, None), (4, None), (4, ""), (5, prose(30, 4)), (5, prose(30, 4)), (6, prose(60, 5)), (6, prose(60, 6)), (6, prose(60, 7))]


def test_near_duplicates_by_rows(spark):
    """Unlike texts under one doc_id, rows without one, and repeated rows."""
    docs = spark.createDataFrame([(i, t, k % 3, {"k": 1}) for k, (i, t) in enumerate(NEAR)], "doc_id long, text string, component int, _row map<string,int>").repartition(3)
    got = jaccard_join.drop_near_duplicates(docs)
    assert got.dtypes == docs.dtypes
    first = sorted(map(str, got.collect()))
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(plain_near(NEAR))
    assert sorted(map(str, jaccard_join.drop_near_duplicates(docs.repartition(1)).collect())) == first


def test_of_linked_texts_under_one_id_one_stays(spark):
    docs = spark.createDataFrame([(1, prose(60, 1)), (1, prose(60, 1) + " x"), (1, prose(60, 1) + " y"), (1, prose(60, 8))], "doc_id long, text string")
    got = [r["text"] for r in jaccard_join.drop_near_duplicates(docs).collect()]
    assert len(got) == 2 and prose(60, 8) in got


def test_scores_against_numpy(spark, tables):
    got = quality.classify(read_table(spark, tables, "documents"), read_table(spark, tables, "labels")).collect()
    want = Counter((d, round(float(s), 6), int(s >= 0.3)) for (d, _), s in zip(rows(), plain_scores(rows(), LABELS), strict=True))
    assert Counter((r["doc_id"], round(r["score"], 6), r["predicted"]) for r in got) == want


def test_pipeline_against_plain_python(spark, tables):
    from tokenizers import Tokenizer

    kept = [r for r, s in zip(rows(), plain_scores(rows(), LABELS), strict=True) if s >= 0.3]
    assert len(kept) < len(rows()) and (40, prose(160, 500)) in kept and not any(d == 40 and "BUY" in t for d, t in kept)
    left = plain_near(plain_lines(kept))
    library, want = Tokenizer.from_file(default_path()), Counter()
    for d, t in left:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            want[d, p, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, tables).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert len({r["sequence_id"] for r in got}) == packing.least_sequences(Counter(r["length"] for r in got), 2048)


def test_pipeline_of_no_documents(spark, tables):
    assert corpus_pipeline.run(spark, f"{tables}/none").count() == 0


def test_stages_keep_columns_and_types(spark, tables):
    docs = read_table(spark, tables, "documents")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs, before = step(spark, docs, tables), docs.dtypes
        assert docs.dtypes == before


def test_the_small_tables(spark):
    docs = read_table(spark, SF, "documents")
    kept = [docs]
    for _, step in corpus_pipeline.STAGES:
        kept.append(step(spark, kept[-1], SF))
    ids = [{r[0] for r in x.select("doc_id").collect()} for x in kept]
    assert ids[1] < ids[0] and ids[2] == ids[1] and ids[3] <= ids[2] and ids[4] == ids[3]
    assert line_dedup.drop_frequent_lines(docs, keep_first=True).count() == docs.count()
