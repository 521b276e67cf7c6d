"""Seeds and their way through links and shared parents, on pages that have both."""

import numpy as np
import pytest

from driftline.llm import url_filter

PAGES = [
    (1, "http://alphabets.example/a", ""),
    (2, "http://adult-learning.example/a", ""),
    (3, "http://vegaspills.example/a", ""),
    (4, "http://cheap-pills.example/a", ""),
    (5, "http://a.shop.test/a", ""),
    (6, "http://b.shop.test/a", ""),
    (7, "http://farm.test/a", '<a href="http://bad.test/x">x</a>'),
    (8, "http://feeder.test/a", "<a href='http://farm.test/'>x</a>"),
    (9, "http://good.test/a", '<a href="http://friend.test/">x</a>'),
    (10, "http://friend.test/a", '<a href="http://bad.test/">x</a>'),
    (11, "http://x.one.co.uk/a", ""),
    (12, "http://one.co.uk/a", ""),
    (13, "http://two.co.uk/a", ""),
    (14, "http://lone.site.test/a", ""),
]
SEEDS = [("bad.test", 1), ("a.shop.test", 1), ("good.test", 0), ("x.one.co.uk", 1)]


@pytest.fixture(scope="module")
def judged(spark):
    rows = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    given = spark.createDataFrame(SEEDS, "host string, kind int")
    return {r["page_id"]: r for r in url_filter.judge_urls(rows, given=given).collect()}


def test_no_name_is_a_seed(judged):
    assert [judged[k]["verdict"] for k in (1, 2, 3, 4)] == ["allow"] * 4


def test_distrust_goes_through_links_and_shared_parents(judged):
    assert [k for k in range(5, 15) if judged[k]["verdict"] == "block"] == [5, 6, 7, 8, 11, 12]
    assert judged[10]["trust"] > judged[10]["distrust"] > 0
    assert judged[7]["distrust"] > judged[8]["distrust"] > 0 and judged[13]["distrust"] == judged[14]["distrust"] == 0


def link(*urls):
    return "".join(f"<a href='{u}'>x</a>" for u in urls)


WEB = [
    (1, "http://one.example.net/en/a", link("//two.test/x", "/own", "a.html", "HTTPS://Three.test")),
    (2, "http://two.test/", link("http://three.test/a", "http://three.test/b", "http://bad.net/")),
    (3, "http://three.test/", link("http://one.example.net/")),
    (4, "http://bad.net/a", link("http://two.test/", "http://worse.test?x")),
    (5, "http://worse.test/", link("http://bad.net/")),
    (6, "http://far.test/", link("http://worse.test/")),
    (7, "http://alone.test/", link("mailto:x@y.test", "#top", "javascript:void(0)", "?q=http://bad.net/")),
]


def ranked(pages):
    """Both scores by numpy, from the same links between hosts that have no parents."""
    hosts = sorted({url_of(u) for _, u, _ in pages} | {"bad.net"})
    m = np.zeros((len(hosts), len(hosts)))
    for _, u, html in pages:
        for x in html.split("'")[1::2]:
            if "//" in x and not x.startswith("?"):
                to = url_of(x.lower())
                if to != url_of(u):
                    m[hosts.index(url_of(u)), hosts.index(to)] += 1
    out = []
    for a, seed in ((m, "one.example.net"), (m.T, "bad.net")):
        share = a / np.maximum(a.sum(axis=1, keepdims=True), 1)
        start = np.array([float(h == seed) for h in hosts])
        score = start
        for _ in range(300):
            score = 0.85 * score @ share + 0.15 * start
        out.append(dict(zip(hosts, score, strict=True)))
    return out


def url_of(url):
    return url.split("//")[1].split("/")[0].split("?")[0]


def test_scores_against_numpy(spark):
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(WEB, "page_id long, url string, html string"), tolerance=1e-8).collect()}
    trust, distrust = ranked(WEB)
    for k, u, _ in WEB:
        assert got[k]["trust"] == pytest.approx(trust[url_of(u)], abs=1e-6) and got[k]["distrust"] == pytest.approx(distrust[url_of(u)], abs=1e-6)
    assert [got[k]["verdict"] for k in range(1, 8)] == ["allow", "allow", "allow", "block", "block", "block", "allow"]


def test_a_link_changes_the_verdict(spark):
    pages = [(*p[:2], "" if p[0] == 6 else p[2]) for p in WEB]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[6] == "allow" and got[5] == "block"


def sparse_ranks(n, edges, kinds):
    """Both scores of n hosts by numpy, from (src, dst, weight) arrays."""
    src, dst, w = edges
    out = []
    for a, b, kind in ((src, dst, 0), (dst, src, 1)):
        share = w / np.bincount(a, weights=w, minlength=n)[a]
        start = (kinds == kind) / max((kinds == kind).sum(), 1)
        score = start
        for _ in range(200):
            score = 0.85 * np.bincount(b, weights=score[a] * share, minlength=n) + 0.15 * start
        out.append(score)
    return out


@pytest.mark.parametrize("broadcast", [10**9, 0])
def test_many_hosts_against_sparse_numpy(spark, monkeypatch, broadcast):
    """10^5 hosts, hubs among them: every verdict, though each host holds a tiny part of the mass; and with edges that are dealt out by salted hosts."""
    n = 100_000 if broadcast else 5_000
    monkeypatch.setattr(url_filter, "BROADCAST_EDGES", broadcast)
    rng = np.random.default_rng(4)
    src, dst = rng.integers(0, n, 2 * n), (rng.zipf(1.6, 2 * n) * 7919) % n
    pairs = np.unique(np.stack([src, dst])[:, src != dst], axis=1)
    w = 1.0 + rng.integers(0, 3, pairs.shape[1])
    kinds = np.where(rng.random(n) < 0.02, rng.integers(0, 2, n), -1)
    edges = spark.createDataFrame(__import__("pandas").DataFrame({"src": pairs[0], "dst": pairs[1], "weight": w})).selectExpr("concat('h', src) as src", "concat('h', dst) as dst", "weight")
    seeds = spark.createDataFrame([(f"h{k}", int(kinds[k])) for k in np.flatnonzero(kinds >= 0)], "host string, kind int")
    got = url_filter.propagate(edges, seeds).toPandas()
    trust, distrust = sparse_ranks(n, (*pairs, w), kinds)
    at = got["host"].str[1:].astype(int).to_numpy()
    assert set(at) == set(np.flatnonzero(trust + distrust > 0))
    share, want = (got["distrust"] / (got["trust"] + got["distrust"])).to_numpy(), distrust[at] / (trust[at] + distrust[at])
    assert np.abs(share - want).max() < 2e-4
    clear = np.abs(want - 0.5) > 2e-4
    assert (((share > 0.5) == (want > 0.5)) | ~clear).all() and clear.mean() > 0.999


def test_verdicts_do_not_depend_on_the_number_of_seeds(spark):
    """A neighbour of one blocked seed among 10^5 others has very little distrust, and no trust at all."""
    seeds = spark.range(100_000).selectExpr("concat('s', id) as host", "1 as kind").union(spark.createDataFrame([("good", 0)], "host string, kind int"))
    edges = spark.createDataFrame([("near", "s7", 1.0), *[("near", f"o{k}", 1e6) for k in range(3)], ("good", "fine", 1.0)], "src string, dst string, weight double")
    got = {r["host"]: r for r in url_filter.propagate(edges, seeds).where("host in ('near', 'fine')").collect()}
    assert got["near"]["distrust"] > 0 == got["near"]["trust"] and got["fine"]["trust"] > 0 == got["fine"]["distrust"]
