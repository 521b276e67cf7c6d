"""Operator 7: pages judged by rules and by their host's place in the link graph (DataFrame functions only).

Hosts are nodes. Edges are the links of the pages: ``href`` with a host, with
or without a scheme; relative ones stay on their host. Since a site's hosts
vouch for one another, there is also one edge each way between a host and its
parent, the name without its first label, if the parent is a host of the pages,
is linked to, or has two such hosts below it. Seeds are hosts that the rules
judge, and those a caller names. Trust is personalised PageRank from the
trusted seeds along the edges; distrust is the same from the blocked seeds
along the reversed edges, as who links to a bad host is suspect. A host is
blocked if its distrust outweighs its trust.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import lower_ascii, parts, read_table, stage, unstage

#: (host, start of path, verdict); a longer host and path wins. A small list: it becomes one CASE expression.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING = 0.85
#: Scores are looked at and written every LOOK rounds, and final when no host was newly reached and no host's share of distrust moved by more than TOLERANCE since: a bound for each host, whatever the number of hosts and seeds.
TOLERANCE, LOOK = 1e-4, 10
#: Edges that may be broadcast (some 100 bytes each). More are dealt out once, a host's in up to SALTS places, and only scores move from then on.
BROADCAST_EDGES, SALTS = 200_000, 16


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """STRUCT(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(src, dst, weight): links of pages (_host, html) between different hosts, and hosts with the parent that they share or that is found. found: (_host) of all pages, each at least once."""
    links = pages.select(F.col("_host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit("(?i)href\\s*=\\s*[\"']?([^\"' >]+)"), F.lit(1))).alias("link"))
    linked = links.select("src", lower_ascii(F.regexp_extract("link", "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)).alias("dst"))
    linked = linked.where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    linked = stage(linked, "links")
    hosts = stage(found.select(F.col("_host").alias("src")).union(linked.select("dst")).distinct(), "hosts")
    # Two labels at least, no address, and no suffix that is sold by the name (co.uk).
    above = F.when(F.size(F.split("src", "\\.")) >= 3, F.expr("substring(src, instr(src, '.') + 1)"))
    below = hosts.withColumn("dst", above).where(F.col("dst").isNotNull() & ~F.col("dst").rlike("[.][0-9:]+$|^[^.]{0,3}[.][a-z]{2}$"))
    shared = below.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select("dst")
    parents = shared.union(hosts.select("src")).distinct()
    pairs = below.join(parents, "dst", "left_semi").select("src", "dst")
    both = pairs.union(pairs.select("dst", "src")).withColumn("weight", F.lit(1.0))
    return stage(linked.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "edges")


def _ways(edges: DataFrame) -> DataFrame:
    """(src, dst, f, b): what share of the trust of src goes to dst, along links, and of its distrust, against them."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("all")).withColumnRenamed("src", "_s")
    into = edges.groupBy("dst").agg(F.sum("weight").alias("all")).withColumnRenamed("dst", "_d")
    none = F.lit(0.0)
    along = edges.join(out, F.col("src") == F.col("_s")).select("src", "dst", (F.col("weight") / F.col("all")).alias("f"), none.alias("b"))
    against = edges.join(into, F.col("dst") == F.col("_d")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), none.alias("f"), (F.col("weight") / F.col("all")).alias("b"))
    return along.union(against).groupBy("src", "dst").agg(F.sum("f").alias("f"), F.sum("b").alias("b"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust). edges: (src, dst, weight); seeds: (host, kind), kind 0 trusted, 1 blocked.

    Personalised PageRank of each kind, the mass of hosts without out-edges
    not passed on. It ends when no host was newly reached in LOOK rounds and
    no host's distrust, as a share of its trust and distrust, moved by more
    than tolerance. No seeds: no scores.
    """
    ways = stage(_ways(edges), "ways")
    is_kind = lambda k: F.when(F.col("kind") == k, 1.0).otherwise(0.0)
    number = seeds.agg(*[F.greatest(F.sum(is_kind(k)), F.lit(1.0)).alias(f"n{k}") for k in (0, 1)]).first()
    start = seeds.groupBy("host").agg(*[(F.sum(is_kind(k)) / (number[f"n{k}"] or 1.0)).alias(c) for k, c in enumerate(("trust", "distrust"))])
    start = stage(start, "seeds")
    back = start.select("host", *[(F.col(c) * (1 - DAMPING)).alias(c) for c in ("trust", "distrust")])
    few = ways.count() <= BROADCAST_EDGES
    if few:
        dealt, places = F.broadcast(ways), None
    else:
        dealt = ways.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")).repartition(parts(edges), "src", "salt").persist()
        places = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    now = start.select("host", "trust", "distrust")  # another frame, which names no folder: start is read in every round
    share = lambda t: t["distrust"] / (t["trust"] + t["distrust"])
    while True:
        score = now
        for _ in range(LOOK):
            met = score.join(dealt, F.col("host") == F.col("src")) if few else score.withColumn("_p", places).join(dealt, (F.col("host") == F.col("src")) & (F.col("_p") == F.col("salt")))
            passed = met.select(F.col("dst").alias("host"), (F.col("trust") * F.col("f") * DAMPING).alias("trust"), (F.col("distrust") * F.col("b") * DAMPING).alias("distrust"))
            score = passed.union(back).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).where("trust > 0 or distrust > 0")
        before, now = now, stage(score, "scores")
        old = before.select(F.col("host").alias("_h"), share(before).alias("_was"))
        moved = now.join(old, F.col("host") == F.col("_h"), "left").agg(F.max(F.coalesce(F.abs(share(now) - F.col("_was")), F.lit(1.0)))).first()[0]
        unstage(before)
        if (moved or 0.0) <= tolerance:
            break
    if not few:
        dealt.unpersist()
    return now.select("host", "trust", "distrust")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, given: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of pages (page_id, url, html).

    Trusted seeds are hosts of which half of the pages or more match an allow
    rule, blocked seeds those of which half or more match a block rule. given
    (host, kind), a host at most once, are seeds beside them, kind 0 trusted
    and 1 blocked;
    they need no page, and go before what rules say. Without a rule a page is blocked if
    distrust / (trust + distrust) of its host exceeds the threshold (by more
    than a billionth of it, so that equal scores allow), else
    allowed; so are pages of no host (null url, no ``://``) or of a host that
    no score reaches. Null html has no links. Repeated rows are judged alike. Very long pages
    are read whole. An empty table gives no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    marked = pages.select("page_id", host.alias("_host"), path.alias("_path"), "html")
    marked = marked.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("_rule.verdict") == verdict, 1.0).otherwise(0.0))
    hosts = stage(marked.where("_host != ''").groupBy("_host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "judged")
    kind = F.when(F.col("blocked") >= 0.5, 1).when(F.col("allowed") >= 0.5, 0)
    seeds = hosts.select(F.col("_host").alias("host"), kind.alias("kind")).where("kind is not null")
    if given is not None:
        given = given.select(lower_ascii(F.col("host")).alias("host"), F.col("kind").cast("int").alias("kind"))
        seeds = seeds.join(given, "host", "left_anti").union(given)
    scores = propagate(host_edges(marked, hosts), seeds, tolerance)
    scores = scores.select(F.col("host").alias("_of"), "trust", "distrust", (F.col("distrust") > threshold * (1 + 1e-9) * (F.col("trust") + F.col("distrust"))).alias("_bad"))
    out = marked.drop("html").join(scores, F.col("_host") == F.col("_of"), "left")
    verdict = F.coalesce("_rule.verdict", F.when(F.col("_bad"), "block").otherwise("allow"))
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")
