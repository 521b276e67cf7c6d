"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import digest, jaccard_join, katz, line_dedup, media_chunks, packing, piece_tokens, quality, token_files, url_filter
from driftline.llm.common import stage_path
from driftline.llm.word_tokens import default_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.default_rng(5)


def prose(n: int, seed: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.zipf(1.5, n) % 5000)


LONG = prose(30_000, 1)
BASE = prose(60, 2)
ROWS = [
    (1, BASE),
    (2, None),
    (3, ""),
    (4, " \n\t\r\n "),
    (5, LONG),
    (6, BASE + " one"),
    (7, BASE.upper()),
    (8, "Same line\nother  thing 8\n SAME LINE \n"),
    (9, "short"),
    (10, "Short\n\n"),
    (11, "Ünïcode ▁ text 🙂 with marks\nSame line"),
    (11, "Ünïcode ▁ text 🙂 with marks\nSame line"),
    (12, BASE + " " + BASE),
    (13, prose(700, 3)),
    (14, prose(700, 3) + " tail"),
    (15, "Don't stop, it's 3.14 <|endoftext|> here"),
    (None, "no id at all"),
    (None, None),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    clashing = ("key", "h", "g", "_row", "_key", "pos", "bucket", "score", "length", "n", "dropped", "_id", "component", "set_id", "held")
    rows = rows.withColumns({c: F.lit(k) for k, c in enumerate(clashing)}).withColumn("n_chars", F.length("text").cast("long"))
    rows.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_id(rows, *columns):
    return Counter(tuple(r[c] for c in ("doc_id", *columns)) for r in rows)


def test_jaccard_join(docs, empty):
    got = jaccard_join.jaccard_join(docs).collect()
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in ROWS]
    up = {d: d for d, _ in ROWS if d is not None}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, (i, _) in enumerate(ROWS):
        for b, (j, _) in enumerate(ROWS[:a]):
            if i is not None and j is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    assert by_id(got, "n_shingles", "component_id") == Counter((i, len(s), None if i is None else find(i)) for (i, _), s in zip(ROWS, sets, strict=True))
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_drop_near_duplicates_keeps_columns(docs):
    kept = jaccard_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert {1, 9, 13} <= set(ids) and not {6, 7, 12, 14} & set(ids) and ids.count(11) == 1


def test_a_group_larger_than_a_block(spark):
    """Copies that differ by a word, more than one block of them, and a chain of links."""
    base = prose(80, 8).split()
    rows = []
    for k in range(700):
        w = list(base)
        w[k % 80] = f"x{k}"
        rows.append((k, " ".join(w)))
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), percent=70).collect()
    assert {r["component_id"] for r in got} == {0}


def turing(counts):
    """The discount of each count, anew: Good-Turing for 1 to 5 where it lies between 0.02 and 0.98, else by a line through log n_r over log r."""
    n = Counter(counts)
    some = [r for r in sorted(n) if r <= 40]
    slope = -2.0
    if len(some) >= 2:
        points = []
        for k, r in enumerate(some):
            before = some[k - 1] if k else 0
            after = some[k + 1] if k + 1 < len(some) else 2 * r - before
            points.append((math.log(r), math.log(n[r] / (0.5 * (after - before)))))
        mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
        slope = min(sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points), -1.05)

    def share(r):
        estimate = (r + 1) * n[r + 1] / (r * n[r]) if r <= 5 and n[r] else 0
        return estimate if r <= 5 and 0.02 < estimate < 0.98 else (1 + 1 / r) ** (slope + 1)

    return share


def brute_katz(rows, held):
    """The same model by dictionaries."""
    seqs = [["<s>", *words(t), "</s>"] for _, t in rows]
    count = [Counter(), Counter(), Counter()]
    for s, out in zip(seqs, held, strict=True):
        if not out:
            count[0].update(s[1:])
            count[1].update(zip(s, s[1:], strict=False))
            count[2].update(zip(s, s[1:], s[2:], strict=False))
    starts = sum(not x for x in held)
    d = [turing(c.values()) for c in count]
    mass = lambda o, c: round(d[o](c) * c * 65536) / 65536
    n = sum(count[0].values())
    unseen = 1 - sum(mass(0, c) for c in count[0].values()) / n
    follow = {}
    for o in (1, 2):
        for g in count[o]:
            follow.setdefault(g[:-1], []).append(g)
    p1 = lambda w: mass(0, count[0][w]) / n if count[0][w] else unseen
    history = lambda h: starts if h == ("<s>",) else count[0][h[0]] if len(h) == 1 else count[1][h]

    def p(gram):
        if len(gram) == 1:
            return p1(gram[0])
        o, h = len(gram) - 1, gram[:-1]
        if count[o][gram]:
            return mass(o, count[o][gram]) / history(h)
        if h not in follow:
            return p(gram[1:])
        left = 1 - sum(mass(o, count[o][g]) for g in follow[h]) / history(h)
        return left / (1 - sum(p(g[1:]) for g in follow[h])) * p(gram[1:])

    scores = [sum(math.log10(p(tuple(s[max(0, k - 2) : k + 1]))) for k in range(1, len(s))) for s in seqs]
    base = [sum(math.log10((count[0][w] + 0.5) / (n + 0.5 * (len(count[0]) + 1))) for w in s[1:]) for s in seqs]
    known = [sum(count[0][w] > 0 for w in s[1:]) for s in seqs]
    return scores, base, known, p, count, follow


def test_katz(docs, empty):
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in ROWS]
    assert any(held) and not all(held)
    scores, base, known, p, count, follow = brute_katz(ROWS, held)
    vocabulary = [*count[0], "never seen"]
    for h in [("short",), *list(follow)[:3], *[h for h in follow if len(h) == 2][:3]]:
        assert sum(p((*h, w)) for w in vocabulary) == pytest.approx(1, abs=1e-6)
    got = katz.katz_scores(docs).collect()
    want = Counter((d, out, len(words(t)) + 1, k, round(b, 5), round(s, 5)) for (d, t), out, s, b, k in zip(ROWS, held, scores, base, known, strict=True))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5)) for r in got) == want
    train = sum(len(words(t)) + 1 for (_, t), out in zip(ROWS, held, strict=True) if not out)
    assert {r["train_tokens"] for r in got} == {train}
    assert katz.katz_scores(empty).count() == 0
    assert {r["score"] for r in katz.katz_scores(docs, F.lit(True)).collect()} == {0.0}


def test_katz_counts_words_apart_that_a_polynomial_hash_does_not(spark):
    from tests.llm.test_exact_ids import morse

    rows = [(k, f"{morse(2048, k % 2)} x") for k in range(6)]
    held = [zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    got = katz.katz_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    _, base, known, *_ = brute_katz(rows, held)
    assert Counter((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in got) == Counter((d, k, round(b, 6)) for (d, _), k, b in zip(rows, known, base, strict=True))


def test_digests_of_equal_and_of_no_rows(docs, empty):
    got = digest.digest_documents(docs).collect()
    of = {r["doc_id"]: r for r in got}
    assert len(got) == len(ROWS) and of[2]["fingerprint"] == of[3]["fingerprint"] == ""
    assert digest.likeness(digest.parsed(of[13]["fingerprint"]), digest.parsed(of[14]["fingerprint"])) > 0.9
    assert digest.digest_documents(empty).count() == 0


def test_entropies_by_definition():
    buf = np.frombuffer(b"aaaaabcdefgh  the quick brown fox" * 9, np.uint8)
    for w in (4, 8, 32):
        got = digest.entropies(buf, w)
        for k in range(0, len(got), 7):
            c = np.array(list(Counter(buf[k : k + w].tolist()).values())) / w
            assert got[k] == pytest.approx(-(c * np.log2(c)).sum() / np.log2(w) * digest.BINS, abs=1.5)


def test_pieces(docs, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for d, t in ROWS:
        ids = library.encode(t or "")
        want[d, tuple(ids), library.decode(ids)] += 1
    got = piece_tokens.encode_pieces(docs, path).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == want
    texts = dict(ROWS)
    for r in got:
        ends = r["ends"]
        assert list(ends) == sorted(ends) and (not ends or ends[-1] == len((texts[r["doc_id"]] or "").encode()) or r["doc_id"] is None)
    assert piece_tokens.encode_pieces(empty, path).count() == 0


def test_quality(spark, docs, empty):
    good = [(k, prose(200, k + 10), 1) for k in range(40)]
    bad = [(k, "BUY NOW!!! $$$ " * 20 + str(k), 0) for k in range(40, 80)]
    rows = spark.createDataFrame([x[:2] for x in good + bad], "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    labels = spark.createDataFrame([(x[0], x[2]) for x in good + bad] + [(9999, None)], "doc_id long, quality int")
    got = quality.classify(rows, labels).collect()
    assert len(got) == 80 + len(ROWS)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 80 and r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] < 40) for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(docs, labels.where("false")).count() == len(ROWS)
    kept = quality.keep_good(rows.withColumn("predicted", F.lit(7)), labels)
    assert kept.columns == ["doc_id", "text", "predicted"] and not any(40 <= (r["doc_id"] or 0) < 80 for r in kept.collect())


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    got = packing.pack_documents(docs, default_path()).collect()
    want = Counter()
    for d, t in ROWS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            cut = np.array(ids[s : s + 2048], "<u4")
            want[d, p, s, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert by_id(got, "piece", "start", "length", "ids_crc32") == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == packing.least_sequences(Counter(r["length"] for r in got), 2048)
    assert packing.pack_documents(empty, default_path()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packings_use_each_piece_once_and_small_ones_are_best(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(rng.integers(1, 20, 12).tolist())
    found = packing.pack_lengths(dict(counts), 20)
    used = Counter()
    for items, n in found:
        assert sum(items) <= 20
        for s in items:
            used[s] += n
    assert used == counts
    assert sum(n for _, n in found) <= sum(n for _, n in packing.best_fit(dict(counts), 20))
    assert sum(n for _, n in found) >= packing.least_sequences(dict(counts), 20)


def test_line_dedup(docs, empty):
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, 3)).collect()
    rows = {(d, t or "") for d, t in ROWS}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    number = Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")} if k)
    want = Counter((d, "\n".join(x for x in (t or "").split("\n") if number[key(x)] < 3)) for d, t in ROWS)
    assert Counter((r["doc_id"], "\n".join(r["_kept"])) for r in got) == want
    dropped = line_dedup.drop_frequent_lines(docs, 2, keep_first=True)
    assert dropped.columns == docs.columns and dropped.dtypes == docs.dtypes
    texts = {r["doc_id"]: r["text"] for r in dropped.collect()}
    assert texts[8] == "Same line\nother  thing 8\n" and "Same line" not in texts[11]
    assert line_dedup.drop_frequent_lines(empty).count() == 0


def test_urls(spark):
    pages = [(1, "http://A.example.net/en/x", None), (2, "https://x.org/fr/1", ""), (3, "https://www.org/de", '<a href="http://cheap-pills.com/">x</a>'), (4, None, "x"), (5, "no scheme", "x"), (6, "http://cheap-pills.com/a?b#c", '<a href=//x>'), (7, "http://foo.net", ""), (8, "ftp://q.example.com/de/", ""), (3, "https://www.org/de", "")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("kind", F.lit(1))
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(rows).collect()}
    assert {(1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "x.org", "/fr/1", "org/fr/", "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "cheap-pills.com", "/a", None, "allow"), (8, "q.example.com", "/de/", "example.com/de/", "block")} <= got
    assert (7, "foo.net", "", None) in {x[:4] for x in got}  # a rule with a path does not fit an empty one
    assert url_filter.judge_urls(rows.where("false")).count() == 0


def test_media(spark, docs, empty):
    folder = stage_path(spark, "media-test")
    got = media_chunks.read_media(media_chunks.store_media(docs, folder), folder).collect()
    want = Counter()
    for d, t in ROWS:
        payload = media_chunks.pad_text((t or "").encode())
        want[d, len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert by_id(got, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    of = {r["doc_id"]: (r["media_sha256"], r["feature"]) for r in got}
    assert of[2] == of[3]
    folder = stage_path(spark, "media-test")
    assert media_chunks.read_media(media_chunks.store_media(empty, folder), folder).count() == 0


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    manifest, dictionary = token_files.write_token_files(docs, default_path(), stage_path(spark, "tokens-test"))
    got = token_files.read_token_files(spark, manifest, dictionary).collect()
    want = Counter()
    for d, t in ROWS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert by_id(got, "n_tokens", "ids_crc32") == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ordered = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert [x for x in ordered if x is not None] == sorted(x for x in ordered if x is not None)
    shard = token_files.ShardReader(manifest[-1]["path"], dictionary)
    assert shard.find(int(shard.ids[-1])) is not None
    with pytest.raises(ValueError):
        token_files.ShardReader(manifest[-1]["path"], b"another")
    manifest, dictionary = token_files.write_token_files(empty, default_path(), stage_path(spark, "tokens-test"))
    assert token_files.read_token_files(spark, manifest, dictionary).count() == 0
