"""The queries of the library's own operators, with their SQL.

Vectors come from the embeddings table. Where sums are compared with SQL the
components are whole multiples of a thousandth, so that they are exact in any
order; results are rounded alike on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions import vectors as V
from driftline.functions.expansions import expand, sigmoid_features
from driftline.operators import cutoff as CO
from driftline.operators import estimators as E
from driftline.operators import graphblocks as GB
from driftline.operators import graphs as G
from driftline.operators import heads as H
from driftline.operators import inversion as I
from driftline.operators import linear_view as LV
from driftline.operators import moments as M
from driftline.operators import neighbours as NB
from driftline.operators import places as P
from driftline.operators import selection as S
from driftline.operators import spectra as SP
from driftline.plans import network as N
from driftline.plans import slots as SL
from driftline.sources import files, synthetic
from driftline.streaming.chunks import chunked
from driftline.streaming.folds import windowed_deltas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "classify_slow_features"
GRAIN = 0.001
#: What sums of products are rounded to: coarse enough for sums in any order, and odd, so that none lies on a half.
UNIT = 97.3


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thousandths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components in whole thousandths."""
    return synthetic.embeddings(spark, sf_dir, grain=GRAIN)


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.embeddings(spark, sf_dir)


SIZE = 64
S64 = "s AS (SELECT vec_id AS ord, label AS class, [round(v::DOUBLE / 0.001) + 0.0 for v in embedding] AS f FROM embeddings), c AS (SELECT count(*) AS n FROM s), k64 AS (SELECT unnest(range(1, 65)) AS i)"
LONG = f"{S64}, l AS (SELECT ord, class, i, f[i] AS x FROM s, k64)"


def r(x: Column, digits: int = 6) -> Column:
    """Rounded, and no negative zero."""
    return F.round(x, digits) + 0.0


# Moments under each training mode, against the graph's pairs one by one.


def moments_rows(spark: SparkSession, m: M.Moments) -> DataFrame:
    size = len(m.sx)
    rows = [(i, j, float(m.q), float(m.r), float(m.sx[i]), float(m.sxx[i, j]), float(m.sdd[i, j])) for i in range(size) for j in range(size)]
    out = spark.createDataFrame(rows, "i int, j int, q double, r double, sx double, sxx double, sdd double")
    sums = [r(F.col(c) / UNIT, 0).alias(c) for c in ("sxx", "sdd")]
    return out.select("i", "j", *[r(F.col(c), 3).alias(c) for c in ("q", "r", "sx")], *sums)


def moments_sql(nodes: str, edges: str, q: str = "(SELECT sum(v) FROM v)", more: str = "") -> str:
    """From the graph's edges, each listed; near: what the edges of a sample lead to."""
    return f"""
WITH {LONG}{more}, v AS ({nodes}), e AS ({edges}),
x AS (SELECT a.i AS i, b.i AS j, sum(v.v * a.x) AS sx, sum(v.v * a.x * b.x) AS sxx FROM l a JOIN l b USING (ord) JOIN v USING (ord) GROUP BY ALL),
deg AS (SELECT ord, sum(w) AS w FROM (SELECT src AS ord, w FROM e UNION ALL SELECT dst, w FROM e) GROUP BY 1),
near AS (SELECT e.src AS ord, l.i, sum(e.w * l.x) AS y FROM e JOIN l ON l.ord = e.dst GROUP BY 1, 2),
own AS (SELECT a.i, b.i AS j, sum(deg.w * a.x * b.x) AS t FROM l a JOIN l b USING (ord) JOIN deg USING (ord) GROUP BY ALL),
met AS (SELECT a.i, b.i AS j, sum(a.x * b.y) AS t FROM l a JOIN near b USING (ord) GROUP BY ALL),
d AS (SELECT own.i, own.j, own.t - m.t - n.t AS sdd FROM own JOIN met m ON m.i = own.i AND m.j = own.j JOIN met n ON n.i = own.j AND n.j = own.i)
SELECT (i - 1)::INT AS i, (j - 1)::INT AS j, round({q}, 3) + 0.0 AS q, round((SELECT sum(w) FROM e), 3) + 0.0 AS r,
  round(sx, 3) + 0.0 AS sx, round(sxx / {UNIT}) + 0.0 AS sxx, round(sdd / {UNIT}) + 0.0 AS sdd FROM x JOIN d USING (i, j)
"""


ALL_ONE = "SELECT ord, 1.0::DOUBLE AS v FROM s"
_BLOCK = 50
_K = f", b AS (SELECT ord, ord // {_BLOCK} AS k, (SELECT n FROM c) // {_BLOCK} - 1 AS last FROM s)"
_ENDS = "CASE WHEN b.k IN (0, b.last) THEN 1.0 ELSE 2.0 END"
_SERIAL = f"SELECT b.ord AS src, t.ord AS dst, 1.0 / {_BLOCK} AS w FROM b JOIN b t ON abs(b.k - t.k) = 1"
_INNER = f"SELECT b.ord AS src, t.ord AS dst, (CASE WHEN b.k IN (0, b.last) THEN 2.0 ELSE 1.0 END) / {_BLOCK} AS w FROM b JOIN b t ON b.k = t.k"


@query(moments_sql(ALL_ONE, "SELECT a.ord AS src, b.ord AS dst, 1.0 AS w FROM s a JOIN s b ON b.ord = a.ord + 1"))
def moments_regular(spark, sf_dir):
    return moments_rows(spark, M.train(thousandths(spark, sf_dir), "regular"))


@query(moments_sql(ALL_ONE, "SELECT a.ord AS src, b.ord AS dst, 1.0 / z.n AS w FROM s a JOIN s b ON a.class = b.class JOIN (SELECT class, count(*) AS n FROM s GROUP BY 1) z ON z.class = a.class"))
def moments_classification(spark, sf_dir):
    return moments_rows(spark, M.train(thousandths(spark, sf_dir), "classification", key=F.col("class")))


@query(moments_sql(ALL_ONE, "SELECT a.ord AS src, b.ord AS dst, 1.0 / (z.n - 1) AS w FROM s a JOIN s b ON a.class = b.class AND a.ord != b.ord JOIN (SELECT class, count(*) AS n FROM s GROUP BY 1) z ON z.class = a.class"))
def moments_clustered_without_loops(spark, sf_dir):
    rows = thousandths(spark, sf_dir)
    return moments_rows(spark, M.merge(M.clustered(rows, SIZE, F.col("class"), loops=False), SIZE))


@query(moments_sql(f"SELECT ord, {_ENDS} AS v FROM b", _SERIAL, more=_K))
def moments_serial(spark, sf_dir):
    return moments_rows(spark, M.train(thousandths(spark, sf_dir), "serial", block=_BLOCK, rest=True))


@query(moments_sql(f"SELECT ord, 3.0 AS v FROM b", f"{_SERIAL} UNION ALL {_INNER}", more=_K))
def moments_mixed(spark, sf_dir):
    return moments_rows(spark, M.train(thousandths(spark, sf_dir), "mixed", block=_BLOCK, rest=True))


@query(moments_sql(f"SELECT ord, {_ENDS} AS v FROM b", _SERIAL, more=f", o AS (SELECT ord, row_number() OVER (ORDER BY class, ord) - 1 AS p FROM s), b AS (SELECT ord, p // {_BLOCK} AS k, (SELECT n FROM c) // {_BLOCK} - 1 AS last FROM o)"))
def moments_serial_regression(spark, sf_dir):
    return moments_rows(spark, M.train(thousandths(spark, sf_dir), "serial_regression", key=F.col("class"), block=_BLOCK, rest=True))


_RAMP = "SELECT ord, least(least(ord + 3, n - 1 - ord + 3), 6) / 6.0 AS v FROM s, c"


@query(moments_sql(_RAMP, "SELECT a.ord AS src, b.ord AS dst, 1.0 AS w FROM s a JOIN s b ON b.ord - a.ord BETWEEN 1 AND 3", q="(SELECT n - 1.0 FROM c)"))
def moments_window(spark, sf_dir):
    return moments_rows(spark, M.train(thousandths(spark, sf_dir), "window3"))


@query(moments_sql(_RAMP, "SELECT a.ord AS src, b.ord AS dst, 1.0 AS w FROM s a JOIN s b ON abs(b.ord - a.ord) BETWEEN 1 AND 3", q="(SELECT n - 1.0 FROM c)"))
def moments_window_both_ways(spark, sf_dir):
    return moments_rows(spark, M.train(thousandths(spark, sf_dir), "fwindow3"))


@query(moments_sql(ALL_ONE, "SELECT a.ord AS src, b.ord AS dst, 1.0 AS w FROM s a JOIN s b ON abs(b.ord - a.ord) BETWEEN 1 AND 3"))
def moments_truncating_window(spark, sf_dir):
    return moments_rows(spark, M.train(thousandths(spark, sf_dir), "truncating_window3"))


@query(moments_sql(ALL_ONE, "SELECT ord AS src, CASE WHEN ord + d < 0 THEN -1 - ord - d WHEN ord + d >= n THEN 2 * n - 1 - ord - d ELSE ord + d END AS dst, 1.0 AS w FROM s, c, (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS d)"))
def moments_mirror_window(spark, sf_dir):
    return moments_rows(spark, M.train(thousandths(spark, sf_dir), "mirror_window3"))


_RING = "SELECT ord AS src, (ord * 7 + 3) % n AS dst, 1.0 + ord % 5 AS w FROM s, c"


def ring(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    rows = spark.range(n)
    return rows.select(F.col("id").alias("sample_id"), (1.0 + F.col("id") % 3).alias("v")), rows.select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % n).alias("dst"), (1.0 + F.col("id") % 5).alias("w"))


@query(moments_sql("SELECT ord, 1.0 + ord % 3 AS v FROM s", _RING))
def moments_graph(spark, sf_dir):
    rows = thousandths(spark, sf_dir)
    nodes, edges = ring(spark, rows.count())
    return moments_rows(spark, M.train(rows, "graph", nodes=nodes, edges=edges))


_HALVES = ", b AS (SELECT ord, ord // 125 AS k FROM s), g AS (SELECT b.ord, b.k, j.j, CASE j.j WHEN 0 THEN 2 * (k // 2 % 2) - 1 WHEN 1 THEN 2 * (k % 2) - 1 ELSE -(2 * (k // 2 % 2) - 1) * (2 * (k % 2) - 1) END AS sign, (CASE j.j WHEN 2 THEN 0.5 ELSE 1.0 END) / 2.5 AS wj FROM b, (SELECT unnest([0, 1, 2]) AS j) j), z AS (SELECT j, sign, count(*) AS n FROM g GROUP BY 1, 2)"


def moments_compact_classes(spark, sf_dir):
    rows = thousandths(spark, sf_dir)
    return moments_rows(spark, M.train(rows, "compact_classes3", block=rows.count() // 4, rest=True))


query(moments_sql("SELECT ord, 1.0::DOUBLE AS v FROM b", "SELECT a.ord AS src, b2.ord AS dst, a.wj / z.n AS w FROM g a JOIN g b2 ON a.j = b2.j AND a.sign = b2.sign JOIN z ON z.j = a.j AND z.sign = a.sign", more=_HALVES.replace("// 125", "// (SELECT n // 4 FROM c)")))(moments_compact_classes)


_MORE = """, p AS (SELECT n1, n2, n1 / 10.0 - 1 + u * n2 AS a, n1 / 10.0 + u * (n2 - 1) AS b, u FROM (SELECT count(*) FILTER (ord % 2 = 0)::DOUBLE AS n1, count(*) FILTER (ord % 2 = 1)::DOUBLE AS n2, pow(2::DOUBLE, -9.5) / 10 AS u FROM s)),
o AS (SELECT ord FROM s WHERE ord % 2 = 1), h AS (SELECT ord, class, count(*) OVER (PARTITION BY class) AS n FROM s WHERE ord % 2 = 0)"""


@query(moments_sql("SELECT ord, CASE WHEN ord % 2 = 0 THEN 1.0::DOUBLE ELSE pow(2::DOUBLE, -9.5) END AS v FROM s", """SELECT x.ord AS src, y.ord AS dst, (p.n1 / 10.0 - 1) / p.a / x.n AS w FROM h x JOIN h y ON x.class = y.class, p
UNION ALL SELECT h.ord, o.ord, p.u * (1 / p.a + 1 / p.b) FROM h, o, p UNION ALL SELECT o.ord, t.ord, p.u * p.u / p.b * (p.n2 - 1) * 10 / p.n2 FROM o, o t, p""", more=_MORE))
def moments_unlabelled_in_classes(spark, sf_dir):
    """The samples of odd order without their labels."""
    rows = thousandths(spark, sf_dir)
    labelled = M.train(rows.where("ord % 2 = 0"), "classification", key=F.col("class"))
    return moments_rows(spark, M.with_unlabelled_in_classes(labelled, rows.where("ord % 2 = 1")))


@query(f"WITH {LONG} SELECT (a.i - 1)::INT AS i, (b.i - 1)::INT AS j, round(covar_pop(a.x, b.x) / {UNIT}, 4) + 0.0 AS covariance FROM l a JOIN l b USING (ord) GROUP BY 1, 2")
def covariance(spark, sf_dir):
    _, cov, _ = M.train(thousandths(spark, sf_dir), "unlabeled").fix()
    rows = [(i, j, float(cov[i, j])) for i in range(SIZE) for j in range(SIZE)]
    return spark.createDataFrame(rows, "i int, j int, covariance double").select("i", "j", r(F.col("covariance") / UNIT, 4).alias("covariance"))


# Slowness of series.


@query("""
WITH d AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d, count(*) OVER (PARTITION BY user_id) AS n,
  avg(value) OVER (PARTITION BY user_id) AS m, stddev_pop(value) OVER (PARTITION BY user_id) AS s FROM events)
SELECT user_id, count(*) AS n, round(avg(d * d), 4) AS delta, round(any_value(n) / (2 * pi()) * sqrt(avg(d * d)), 4) AS eta, round(avg((d / s) * (d / s)), 4) AS normalised_delta
FROM d GROUP BY user_id
""")
def event_slowness(spark, sf_dir):
    """Mean squared difference of each user's values in order of time, eta = n / (2 pi) sqrt(delta), and delta at variance 1."""
    by = W.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").select("user_id", "value", (F.col("value") - F.lag("value").over(by.orderBy("ts", "event_id"))).alias("d"))
    out = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.avg(F.col("d") * F.col("d")).alias("delta"), F.var_pop("value").alias("v"))
    return out.select("user_id", "n", F.round("delta", 4).alias("delta"), F.round(F.col("n") / (2 * math.pi) * F.sqrt("delta"), 4).alias("eta"), F.round(F.col("delta") / F.col("v"), 4).alias("normalised_delta"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, user_id, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS spread FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return windowed_deltas(table(spark, sf_dir, "events")).select(F.col("window.start").alias("start"), "user_id", "n", F.round("mean", 4).alias("mean"), F.round("spread", 4).alias("spread"))


@query(f"WITH {LONG}, m AS (SELECT class, i, count(*) AS n, avg(x) AS m FROM l GROUP BY 1, 2) SELECT (i - 1)::INT AS i, round(sum(2.0 * n / (n - 1) * (q / n - m * m) * n) / (SELECT n FROM c), 4) AS delta FROM m JOIN (SELECT class, i, sum(x * x) AS q FROM l GROUP BY 1, 2) USING (class, i) GROUP BY i")
def typical_delta_of_classes(spark, sf_dir):
    """The mean squared difference of two different samples of one class."""
    m = M.merge(M.clustered(thousandths(spark, sf_dir), SIZE, F.col("class"), loops=False), SIZE)
    rows = [(i, float(m.sdd[i, i] / m.r)) for i in range(SIZE)]
    return spark.createDataFrame(rows, "i int, delta double").select("i", F.round("delta", 4).alias("delta"))


def _delta_rows(spark, delta, eta) -> DataFrame:
    return spark.createDataFrame([(i, float(d), float(e)) for i, (d, e) in enumerate(zip(delta, eta, strict=True))], "i int, delta double, eta double").select("i", F.round("delta", 4).alias("delta"), F.round("eta", 6).alias("eta"))


@query(f"WITH {LONG}, b AS (SELECT ord // {_BLOCK} AS k, i, avg(x) AS m, avg(x * x) AS q FROM l GROUP BY 1, 2), d AS (SELECT a.i, avg(a.q + b.q - 2 * a.m * b.m) AS d, count(*) + 1 AS n FROM b a JOIN b ON b.k = a.k + 1 AND b.i = a.i GROUP BY 1) SELECT (i - 1)::INT AS i, round(d, 4) AS delta, round(n / (2 * pi()) * sqrt(d), 6) AS eta FROM d")
def typical_delta_of_blocks(spark, sf_dir):
    """Of a sequence of one sample from each block after another."""
    return _delta_rows(spark, *M.typical_deltas(thousandths(spark, sf_dir), "serial", block=_BLOCK, rest=True))


@query(f"WITH {LONG}, d AS (SELECT i, x, x - lag(x) OVER (PARTITION BY i ORDER BY ord) AS d FROM l) SELECT (i - 1)::INT AS i, round(avg(d * d), 4) AS delta, round(any_value((SELECT n FROM c)) / (2 * pi()) * sqrt(avg(d * d)), 6) AS eta FROM d GROUP BY i")
def slowness_of_components(spark, sf_dir):
    return _delta_rows(spark, *M.typical_deltas(thousandths(spark, sf_dir), "regular"))


_BOTH = "SELECT src, dst, w FROM (SELECT a.ord AS src, b.ord AS dst, 1.0 AS w FROM s a JOIN s b ON b.ord = a.ord + 1 UNION ALL SELECT a.ord, b.ord, 1.0 / z.n FROM s a JOIN s b ON a.class = b.class JOIN (SELECT class, count(*) AS n FROM s GROUP BY 1) z ON z.class = a.class)"


@query(moments_sql("SELECT ord, 2.0::DOUBLE AS v FROM s", _BOTH))
def moments_of_two_modes(spark, sf_dir):
    """The samples in order, and the classes, in one pass."""
    return moments_rows(spark, M.train(thousandths(spark, sf_dir), ["regular", ("classification", {"key": F.col("class")})]))


# Projections and expansions, a row for each number.


def long_rows(rows: DataFrame, column: str = "y", digits: int = 4) -> DataFrame:
    return rows.select(F.col("sample_id").alias("ord"), F.posexplode(column).alias("k", "v")).select("ord", "k", r(F.col("v"), digits).alias("v"))


def long_sql(body: str, digits: int = 4) -> str:
    """body: (ord, k, v)."""
    return f"WITH {VECTORS} SELECT ord, k::INT AS k, round(v, {digits}) + 0.0 AS v FROM ({body})"


def placed(rows: DataFrame, column: str = "y") -> DataFrame:
    """A row for each place of a long vector: how many samples, and the mean, least and most there."""
    out = rows.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    return out.select("k", "n", *[r(F.col(c)).alias(c) for c in ("mean", "low", "high")])


def placed_expansion(rows: DataFrame, name: str) -> DataFrame:
    """placed of an expansion, by tasks that keep four numbers a place where it is one into monomials; vectors of another size have its places too, null where they end."""
    x = F.col("features")
    rows = rows.withColumn("features", F.when(F.size(x) == SIZE, x).otherwise(V.gather(x, range(SIZE))))
    if not P.told(name):
        return placed(expanded(rows, name))
    return P.place_moments(rows, SIZE, name).select("k", "n", *[r(F.col(c)).alias(c) for c in ("mean", "low", "high")])


def placed_sql(body: str, more: str = "") -> str:
    """body: (k, v)."""
    return f"WITH {VECTORS}{more} SELECT k::INT AS k, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(min(v), 6) + 0.0 AS low, round(max(v), 6) + 0.0 AS high FROM ({body}) GROUP BY 1"


#: f: whole thousandths, x: the components as they are, whose products never lie on a half of the last digit; k2 and k3: pairs and triples of places, in order.
VECTORS = f"""{S64}, x AS (SELECT vec_id AS ord, s.f, [v::DOUBLE for v in embedding] AS x FROM embeddings JOIN s ON s.ord = vec_id),
k2 AS (SELECT a.i AS a, b.i AS b, row_number() OVER (ORDER BY a.i, b.i) - 1 AS k FROM k64 a, k64 b WHERE b.i >= a.i),
k3 AS (SELECT k2.a, k2.b, t.i AS c, row_number() OVER (ORDER BY a, b, t.i) - 1 AS k FROM k2, k64 t WHERE t.i >= k2.b)"""
PAIRS, TRIPLES = SIZE * (SIZE + 1) // 2, SIZE * (SIZE + 1) * (SIZE + 2) // 6


def expanded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumn("y", expand(F.col("features"), SIZE, *names))


@query(long_sql("SELECT ord, i - 1 AS k, f[(7 * (i - 1) + 3) % 64 + 1] AS v FROM x, k64"))
def gather_components(spark, sf_dir):
    return long_rows(thousandths(spark, sf_dir).withColumn("y", V.gather(F.col("features"), [(7 * i + 3) % SIZE for i in range(SIZE)])))


@query(long_sql("SELECT ord, i - 1 AS k, CASE WHEN i <= 32 THEN f[i] ELSE 0 END AS v FROM x, k64"))
def head_and_its_inverse(spark, sf_dir):
    return long_rows(thousandths(spark, sf_dir).withColumn("y", V.head_inverse(V.head(F.col("features"), 32), SIZE)))


@query(long_sql("SELECT ord, k, f[i] / sqrt(1 + (i - 1) % 3) AS v FROM x, (SELECT i, row_number() OVER (ORDER BY i, t) - 1 AS k FROM k64, (SELECT unnest(range(0, 3)) AS t) WHERE t <= (i - 1) % 3)"))
def switchboard(spark, sf_dir):
    """Every component goes to one, two or three outputs."""
    return long_rows(thousandths(spark, sf_dir).withColumn("y", V.switchboard(F.col("features"), [i for i in range(SIZE) for _ in range(1 + i % 3)])))


@query(long_sql("SELECT ord, i - 1 AS k, CASE WHEN i % 2 = 1 THEN f[i] ELSE 0 END AS v FROM x, k64"))
def switchboard_and_its_inverse(spark, sf_dir):
    """Every second component goes to outputs; the inverse gives 0 for the others."""
    wired = [i for i in range(0, SIZE, 2) for _ in range(1 + i % 3)]
    return long_rows(thousandths(spark, sf_dir).withColumn("y", V.switchboard_inverse(V.switchboard(F.col("features"), wired), wired, SIZE)))


@query(long_sql("SELECT ord, 2 * (i - 1) + t AS k, f[i] AS v FROM x, k64, (SELECT unnest([0, 1]) AS t)"))
def wider(spark, sf_dir):
    return long_rows(thousandths(spark, sf_dir).withColumn("y", V.wider(F.col("features"), 2)))


@query(long_sql("SELECT ord, i - 1 AS k, least(greatest(f[i], -50), 80) AS v FROM x, k64 UNION ALL SELECT ord, 63 + i, 100 * tanh(f[i] / 100) FROM x, k64 UNION ALL SELECT ord, 128, sqrt(list_sum([v * v for v in f]) / 64) FROM x"))
def clipped_values(spark, sf_dir):
    """Clipped, clipped softly, and the vector's root mean square."""
    x = F.col("features")
    return long_rows(thousandths(spark, sf_dir).withColumn("y", F.concat(V.clip(x, -50, 80), V.soft_clip(x, 100.0), F.array(V.root_mean_square(x)))))


_QUAD = "SELECT k, x[a] * x[b] AS v FROM x, k2"
_CUBE = "SELECT k, x[a] * (x[b] * x[c]) AS v FROM x, k3"


@query(placed_sql(_QUAD))
def expand_quadratic(spark, sf_dir):
    return placed_expansion(whole(spark, sf_dir), "QT")


@query(placed_sql(_CUBE))
def expand_cubic(spark, sf_dir):
    return placed_expansion(whole(spark, sf_dir), "CT")


@query(long_sql("SELECT ord, 2 * (i - 1) + d AS k, f[i] * f[i + d] AS v FROM x, k64, (SELECT unnest([0, 1]) AS d) WHERE i < 64 UNION ALL SELECT ord, 126 + 2 * (i - 1) + d - 1, sqrt(abs(f[i] - f[i + d])) FROM x, k64, (SELECT unnest([1, 2]) AS d) WHERE i < 63"))
def expand_neighbours(spark, sf_dir):
    return long_rows(expanded(thousandths(spark, sf_dir), "product_adj2", "sqrt_abs_dif_mix2"))


@query(placed_sql("SELECT i - 1 AS k, cos(pi() * x[i]) AS v FROM x, k64 UNION ALL SELECT 64 + k, cos(pi() * (x[a] + x[b])) FROM x, k2"))
def expand_cosines(spark, sf_dir):
    return placed(expanded(whole(spark, sf_dir), "cos1", "cos2"))


@query(long_sql("SELECT ord, i - 1 AS k, pow(abs(x[i]), 0.8) AS v FROM x, k64 UNION ALL SELECT ord, 63 + i, sign(x[i]) * pow(abs(x[i]), 1.5) FROM x, k64 UNION ALL SELECT ord, 127 + i, exp(-x[i] * x[i]) FROM x, k64", 6))
def expand_powers(spark, sf_dir):
    return long_rows(expanded(whole(spark, sf_dir), "u08", "s15", "gauss"), digits=6)


@query(placed_sql("SELECT k, z[a] * z[b] AS v FROM z, k2 WHERE b <= 32 AND a <= 32".replace("k2 WHERE", "(SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS k FROM k2 WHERE b <= 32) WHERE") + """
UNION ALL SELECT 527 + i, greatest(x[i], x[i + 1]) FROM x, k64 WHERE i < 64 UNION ALL SELECT 591 + 32 * (a.i - 1) + b.i - 1, x[a.i] * x[32 + b.i] FROM x, k64 a, k64 b WHERE a.i <= 32 AND b.i <= 32""", ", z AS (SELECT ord, x[3:10] || x[19:26] || x[35:42] || x[51:58] AS z FROM x)"))
def expand_channels(spark, sf_dir):
    """Pairs of eight components of each of four channels, neighbours' maxima, and products of the halves."""
    return placed(expanded(whole(spark, sf_dir), "ch4_o2_s8_QT", "neighbour_max", "halves_product"))


def _signed(x: str, p: float) -> str:
    return f"sign({x}) * pow(abs({x}), {p})"


@query(long_sql(f"""SELECT ord, i - 1 AS k, CASE WHEN x[i] < 0 THEN 2 - exp(-pow(x[i], 2)) ELSE exp(-pow(x[i], 2)) END AS v FROM x, k64
UNION ALL SELECT ord, 63 + i, tanh(0.5 * {_signed('x[i]', 1.5)}) / 0.5 FROM x, k64
UNION ALL SELECT ord, 127 + i, {_signed('x[i]', 0.2)} * {_signed('x[i + 1]', 0.7)} FROM x, k64 WHERE i < 64
UNION ALL SELECT ord, 190 + i, (least(x[i], x[i + 1], x[i + 2]) + greatest(x[i], x[i + 1], x[i + 2])) / 2 FROM x, k64 WHERE i < 63
UNION ALL SELECT ord, 252 + i, greatest(x[i], x[i + 1], x[i + 2]) FROM x, k64 WHERE i < 63""", 6))
def expand_folded_and_modulated(spark, sf_dir):
    return long_rows(expanded(whole(spark, sf_dir), "folded_gauss", "tanh_s15_05", "modulate_02_07", "midrange3", "max3"), digits=6)


#: What each normaliser does, as the method defines it: z is the normalised vector, g the factor of all monomials. d: exponent.
_BY = {
    "AN": ("[v / (1.0 + pow(abs(v), {d})) for v in x]", "1.0"),
    "AE": ("[v / (1.0 + exp(abs(v) * {d})) for v in x]", "1.0"),
    "AP": ("[sign(v) * pow(abs(v), {d}) for v in x]", "1.0"),
    "N": ("x", "1 / (1.0 + pow(sqrt(list_sum([v * v for v in x]) / 64), {d}))"),
    "E": ("x", "1 / (1.0 + exp({d} * sqrt(list_sum([v * v for v in x]) / 64)))"),
}
_NORMED = [(f"{q}_{kind}{e}", kind, d) for q, low, high, e, special in (("Q", 0.6, 0.4, "", None), ("C", 0.73, 0.3, "", None), ("Q", 1.0, 1.0, "_exp", 0.6), ("C", 1.0, 1.0, "_exp", 0.7333)) for kind in _BY for d in [special if special and kind in ("AN", "N") else high if kind == "AP" else low]]
_NORMED += [("S_exp", "", 0.8), ("Q_exp", "AP", 1.0), ("C_exp", "AP", 1.0)]


def normalised_sql(name: str, kind: str, d: float) -> str:
    if name == "S_exp":
        return placed_sql("SELECT i - 1 AS k, x[i] AS v FROM x, k64 UNION ALL SELECT 63 + i, pow(abs(x[i]), 0.8) FROM x, k64")
    z, g = (t.format(d=d) for t in _BY[kind])
    of = "x" if name == "C_AN_exp" else "z"  # there only the vector itself is normalised
    quad, cube = (lambda at: f"SELECT {at} + k, ({of}[a] * {of}[b]) * g FROM z, k2"), (lambda at: f"SELECT {at} + k, ({of}[a] * ({of}[b] * {of}[c])) * g FROM z, k3")
    if not name.endswith("_exp"):
        body = (quad if name[0] == "Q" else cube)(0).replace("* g", "* g AS v", 1).replace("+ k,", "+ k AS k,", 1)
    else:
        body = f"SELECT i - 1 AS k, z[i] * g AS v FROM z, k64 UNION ALL {quad(64)}" + (f" UNION ALL {cube(64 + PAIRS)}" if name[0] == "C" else "")
    return placed_sql(body, f", z AS (SELECT ord, x, {z} AS z, {g} AS g FROM x)")


def _normalised_query(name: str):
    def run(spark, sf_dir):
        return placed_expansion(whole(spark, sf_dir), name)

    run.__name__ = f"expand_{name}"
    run.__doc__ = f"The expansion {name} of all vectors, by place."
    return run


for _name, _kind, _d in _NORMED:
    query(normalised_sql(_name, _kind, _d))(_normalised_query(_name))


@query(f"WITH {S64} SELECT ord AS sample_id, class || ' ' || array_to_string([z[1]::INT || ':' || z[2] for z in list_zip(range(1, 65)::DOUBLE[], f)], ' ') AS line FROM s")
def libsvm_lines(spark, sf_dir):
    return thousandths(spark, sf_dir).select("sample_id", files.libsvm_line(F.col("class"), F.col("features")).alias("line"))


# Ranges, cut-off, equalisation.


@query(f"WITH {LONG} SELECT (i - 1)::INT AS i, min(x) AS low, max(x) AS high FROM l GROUP BY i")
def component_ranges(spark, sf_dir):
    return E.ranges(thousandths(spark, sf_dir))


@query(f"""WITH {LONG}, b AS (SELECT i, min(x) AS low, max(x) AS high FROM l WHERE class < 2 GROUP BY i),
d AS (SELECT ord, i, least(greatest(x, low), high) AS y, abs(x - least(greatest(x, low), high)) AS d FROM l JOIN b USING (i))
SELECT ord, round(sum(y), 4) + 0.0 AS total, round(product(1 - pow(d / (d + 150), 2)), 6) AS correction FROM d GROUP BY ord""")
def cut_off(spark, sf_dir):
    """All samples cut to the bounds that those of classes 0 and 1 have."""
    rows = thousandths(spark, sf_dir)
    low, high = E.bounds(rows.where("class < 2"))
    out = E.cut_off(rows, low, high, 150.0)
    return out.select(F.col("sample_id").alias("ord"), r(V.total(F.col("features")), 4).alias("total"), F.round("correction", 6).alias("correction"))


@query(f"WITH {LONG}, b AS (SELECT i, min(x) AS low, max(x) AS high FROM l GROUP BY i) SELECT ord, (i - 1)::INT AS k, round(-1 + 2 * (x - low) / (high - low), 6) + 0.0 AS v FROM l JOIN b USING (i)")
def normalise_to_range(spark, sf_dir):
    rows = thousandths(spark, sf_dir)
    return long_rows(rows.withColumn("y", E.fit_range(rows)), digits=6)


@query(f"WITH {LONG}, b AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM l GROUP BY i) SELECT ord, (i - 1)::INT AS k, round((x - m) / s, 6) + 0.0 AS v FROM l JOIN b USING (i)")
def standardise(spark, sf_dir):
    return long_rows(E.standardise(thousandths(spark, sf_dir)), "features", 6)


@query("""
WITH o AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS p, count(*) OVER () AS n FROM lineitem),
w AS (SELECT k, round(k * (n - 1) / 10.0)::BIGINT AS p FROM (SELECT unnest(range(0, 11)) AS k), (SELECT any_value(n) AS n FROM o)),
p AS (SELECT k, x AS low, lead(x) OVER (ORDER BY k) AS high, 0.5 - 0.5 * cos(k / 10.0 * pi()) AS a, 0.5 - 0.5 * cos((k + 1) / 10.0 * pi()) AS b FROM o JOIN w USING (p))
SELECT l_orderkey, l_linenumber, l_extendedprice, round(least(greatest(a + (l_extendedprice - low) * ((b - a) / (high - low)), 0), 1), 6) + 0.0 AS equalised
FROM lineitem JOIN p ON high IS NOT NULL AND (l_extendedprice > low OR k = 0) AND l_extendedprice <= high
""")
def equalise_prices(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    at = E.pivots(rows.select(F.col("l_extendedprice").alias("x")), 11)
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", r(E.equalise(F.col("l_extendedprice"), at)).alias("equalised"))


# Graphs.

BLOCK = 10


def number(spark, sf_dir) -> int:
    """Nodes of the graphs below: the rows of the embeddings table, by their place."""
    return table(spark, sf_dir, "embeddings").count()


def edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", r(F.col("w")).alias("w"))


def edges_sql(body: str, head: str = "") -> str:
    return f"WITH n AS (SELECT vec_id AS id FROM embeddings), m AS (SELECT count(*) AS m FROM n){head}, e AS ({body}) SELECT src, dst, round(sum(w), 6) + 0.0 AS w FROM e GROUP BY 1, 2"


_GB = f", b AS (SELECT id, id // {BLOCK} AS k, m // {BLOCK} - 1 AS last FROM n, m)"
_G_SERIAL = "SELECT b.id AS src, t.id AS dst, 1.0 AS w FROM b JOIN b t ON abs(b.k - t.k) = 1"
_G_MIXED = f"{_G_SERIAL} UNION ALL SELECT b.id, t.id, CASE WHEN b.k IN (0, b.last) THEN 2.0 ELSE 1.0 END FROM b JOIN b t ON b.k = t.k"


@query(edges_sql("SELECT a.id AS src, b.id AS dst, 1.0 AS w FROM n a JOIN n b ON abs(a.id - b.id) = 1 UNION ALL SELECT id, id, 1.0 FROM n, m WHERE id IN (0, m - 1)"))
def graph_linear(spark, sf_dir):
    return edge_rows(G.linear(spark, number(spark, sf_dir))[1])


@query("WITH z AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT a.vec_id AS src, b.vec_id AS dst, round(1.0 / (n - 1), 6) + 0.0 AS w FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id != b.vec_id JOIN z ON z.label = a.label")
def graph_clustered(spark, sf_dir):
    return G.clustered(whole(spark, sf_dir).select("sample_id", F.col("class").alias("cluster")), weigh=r)[1]


@query(edges_sql(_G_SERIAL, _GB))
def graph_serial(spark, sf_dir):
    return edge_rows(G.serial(spark, number(spark, sf_dir), BLOCK)[1])


@query(edges_sql(_G_MIXED, _GB))
def graph_mixed(spark, sf_dir):
    return edge_rows(G.mixed(spark, number(spark, sf_dir), BLOCK)[1])


@query(edges_sql(f"{_G_SERIAL} UNION ALL SELECT b.id, t.id, 0.5 * CASE WHEN b.k IN (0, b.last) THEN 2.0 ELSE 1.0 END FROM b JOIN b t ON b.k = t.k AND b.id != t.id", _GB))
def graph_improved(spark, sf_dir):
    return edge_rows(G.improved(spark, number(spark, sf_dir), BLOCK, 0.5)[1])


_WINDOW = ", p AS (SELECT a.id AS src, b.id AS dst, (CASE WHEN a.id + b.id + 2 <= 5 OR a.id + b.id + 2 >= 2 * m - 1 THEN 2.0 ELSE 1.0 END) / 8 AS w FROM m, n a JOIN n b ON a.id != b.id AND abs(a.id - b.id) <= 4)"


@query(edges_sql("SELECT * FROM p UNION ALL SELECT src, src, 1 - sum(w) FROM p GROUP BY src HAVING sum(w) < 1 - 1e-12", _WINDOW))
def graph_sliding_window(spark, sf_dir):
    return edge_rows(G.sliding_window(spark, number(spark, sf_dir), 4)[1])


@query(edges_sql("SELECT a.id AS src, b.id AS dst, a.wj / (2.0 * a.size - 1) AS w FROM g a JOIN g b ON a.j = b.j AND a.sign = b.sign AND a.id != b.id", ", g AS (SELECT id, m // 4 AS size, j, CASE j WHEN 0 THEN id // (2 * (m // 4)) ELSE id // (m // 4) % 2 END AS sign, 0.5 AS wj FROM n, m, (SELECT unnest([0, 1]) AS j) WHERE id < m // 4 * 4)"))
def graph_compact_classes(spark, sf_dir):
    return G.compact_classes(spark, 4, number(spark, sf_dir) // 4, weigh=r)[1]


_RG = ", g AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*)::DOUBLE AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1, 2), v AS (SELECT s_suppkey AS id, (1.0 + s_nationkey % 3)::DOUBLE AS v FROM supplier)"


def supplies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers, and how often one's line of an order is followed by another's."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("dst"))
    edges = lines.join(after, ["l_orderkey", "l_linenumber"]).groupBy(F.col("l_suppkey").alias("src"), "dst").agg(F.count("*").cast("double").alias("w"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_id"), (1.0 + F.col("s_nationkey") % 3).alias("v")), edges


@query(edges_sql("SELECT src, dst, w / 2 AS w FROM g UNION ALL SELECT dst, src, w / 2 FROM g", _RG))
def graph_symmetric(spark, sf_dir):
    return edge_rows(G.symmetric(supplies(spark, sf_dir)[1]))


@query(edges_sql("SELECT src, dst, w / sqrt(a.v * b.v) AS w FROM g JOIN v a ON a.id = src JOIN v b ON b.id = dst", _RG))
def graph_normalised(spark, sf_dir):
    return edge_rows(G.normalised(*supplies(spark, sf_dir)))


@query(edges_sql("SELECT src, dst, w / (1 + k * q * q / r) AS w FROM (SELECT src, dst, w - h AS w FROM g, h UNION ALL SELECT a.id, b.id, k * a.v * b.v FROM v a, v b, t WHERE k > 0), t", _RG + ", h AS (SELECT 0.5 * avg(w) AS h FROM g), t AS (SELECT greatest(-min((w - h) / (a.v * b.v)), 0) AS k, (SELECT sum(v) FROM v) AS q, sum(w - h) AS r FROM g JOIN v a ON a.id = src JOIN v b ON b.id = dst, h)"))
def graph_without_negative_weights(spark, sf_dir):
    """The suppliers' graph less half of its mean weight."""
    nodes, edges = supplies(spark, sf_dir)
    half = 0.5 * edges.agg(F.avg("w")).first()[0]
    return edge_rows(G.without_negative_weights(nodes, edges.withColumn("w", F.col("w") - half)))


@query(edges_sql("SELECT * FROM g UNION ALL SELECT id, -u, 0.5 * q / 6 / c FROM v, t, (SELECT unnest(range(1, 7)) AS u) UNION ALL SELECT -u, id, 0.5 * q / 6 / c FROM v, t, (SELECT unnest(range(1, 7)) AS u)", _RG + ", t AS (SELECT sum(v) AS q, count(*) AS c FROM v)"))
def graph_with_unlabelled(spark, sf_dir):
    nodes, edges = supplies(spark, sf_dir)
    return edge_rows(G.add_unlabelled(nodes, edges, spark.range(1, 7).select((-F.col("id")).alias("sample_id")))[1])


@query(f"WITH n AS (SELECT vec_id AS id FROM embeddings), m AS (SELECT count(*) AS m FROM n){_RG}, o AS (SELECT src AS id, sum(w) AS o FROM g GROUP BY 1), i AS (SELECT dst AS id, sum(w) AS i FROM g GROUP BY 1), t AS (SELECT sum(v) AS q, (SELECT sum(w) FROM g) AS r FROM v) SELECT id AS sample_id, round(v / q, 6) AS node_share, round(coalesce(o, 0) / r, 6) AS out_share, round(coalesce(i, 0) / r, 6) AS in_share, abs(v / q - coalesce(o, 0) / r) <= 1e-6 AND abs(v / q - coalesce(i, 0) / r) <= 1e-6 AS consistent FROM v LEFT JOIN o USING (id) LEFT JOIN i USING (id), t")
def graph_consistency(spark, sf_dir):
    rows = G.consistency(*supplies(spark, sf_dir))
    return rows.select("sample_id", *[F.round(c, 6).alias(c) for c in ("node_share", "out_share", "in_share")], "consistent")


@query(f"WITH {S64}, e AS ({_RING}) SELECT (k - 1)::INT AS i, round(sum(w * (t.f[k] - s.f[k]) ** 2) / sum(w), 4) AS delta FROM e JOIN s ON s.ord = e.src JOIN s t ON t.ord = e.dst, (SELECT unnest(range(1, 65)) AS k) GROUP BY k")
def graph_deltas(spark, sf_dir):
    rows = thousandths(spark, sf_dir)
    return G.graph_deltas(rows, ring(spark, rows.count())[1]).select("i", F.round("delta", 4).alias("delta"))


@query("WITH v AS (SELECT vec_id, label, 1.0 + vec_id % 3 AS v FROM embeddings), m AS (SELECT sum(v * label) / sum(v) AS m, sum(v * label * label) / sum(v) AS q FROM v) SELECT vec_id AS sample_id, round((label - m) / sqrt(q - m * m), 6) + 0.0 AS response FROM v, m")
def free_response_of_label(spark, sf_dir):
    rows = G.free_responses(whole(spark, sf_dir), [F.col("class")], 1.0 + F.col("sample_id") % 3)
    return rows.select("sample_id", r(F.get("free", 1)).alias("response"))


@query("SELECT vec_id AS sample_id, 64 + 2 AS size, round(embedding[1]::DOUBLE, 6) + 0.0 AS first, round(l.a, 6) + 0.0 AS added, round(l.b, 6) + 0.0 AS last FROM embeddings JOIN (SELECT o_orderkey % (SELECT count(*) FROM embeddings) AS k, avg(o_totalprice) AS a, count(*)::DOUBLE AS b FROM orders GROUP BY 1) l ON k = vec_id")
def features_of_two_sources(spark, sf_dir):
    """Vectors that go on with two numbers from the orders."""
    rows = whole(spark, sf_dir)
    more = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % rows.count()).alias("sample_id")).agg(F.array(F.avg("o_totalprice"), F.count("*").cast("double")).alias("features"))
    out = N.with_more_features(rows, more)
    return out.select("sample_id", F.size("features").alias("size"), *[r(F.get("features", k)).alias(n) for k, n in ((0, "first"), (64, "added"), (65, "last"))])


# Heads and measures.

_DIST = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(a.f, b.f)])"


@query("SELECT label AS class, k AS i, round(avg(round(embedding[k + 1]::DOUBLE / 0.001)), 4) + 0.0 AS mean FROM embeddings, (SELECT unnest(range(0, 64))::INT AS k) GROUP BY 1, 2")
def class_means(spark, sf_dir):
    rows = H.class_means(thousandths(spark, sf_dir)).select("class", F.posexplode("mean").alias("i", "mean"))
    return rows.select(F.col("class").cast("int").alias("class"), "i", r(F.col("mean"), 4).alias("mean"))


@query(f"""WITH {S64}, m AS (SELECT class, list(m ORDER BY k) AS f FROM (SELECT class, k, avg(f[k]) AS m FROM s, (SELECT unnest(range(1, 65)) AS k) GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT a.ord, a.class, b.class AS guess, row_number() OVER (PARTITION BY a.ord ORDER BY {_DIST}, b.class) AS p FROM s a, m b)
SELECT class::INT AS truth, guess::BIGINT AS guess, count(*) AS n FROM d WHERE p = 1 GROUP BY 1, 2""")
def nearest_mean_confusion(spark, sf_dir):
    rows = thousandths(spark, sf_dir)
    return H.confusion(H.nearest_mean(rows, H.class_means(rows)), "class", "predicted")


def _near(spark, sf_dir, k: int) -> DataFrame:
    rows = thousandths(spark, sf_dir)
    return NB.nearest(rows.select(F.col("sample_id").alias("query_id"), "features"), rows.select(F.col("sample_id").alias("reference_id"), "features"), k, skip_same=True).select("query_id", "reference_id", "rank", "distance2")


_NEAR = f"{S64}, d AS (SELECT a.ord AS query_id, b.ord AS reference_id, b.class, {_DIST} AS d FROM s a, s b), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, reference_id) AS rank FROM d WHERE d > 0)"


@query(f"WITH {_NEAR} SELECT query_id, reference_id, rank::INT AS rank, d AS distance2 FROM p WHERE rank <= 3")
def three_nearest(spark, sf_dir):
    return _near(spark, sf_dir, 3)


@query(f"WITH {_NEAR}, v AS (SELECT query_id, class, count(*) AS n FROM p WHERE rank <= 5 GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, class) AS q FROM v) SELECT w.query_id, w.class::INT AS predicted, round(a.a, 6) AS average FROM w JOIN (SELECT query_id, avg(class) AS a FROM p WHERE rank <= 5 GROUP BY 1) a USING (query_id) WHERE q = 1")
def neighbour_votes(spark, sf_dir):
    labels = whole(spark, sf_dir).select(F.col("sample_id").alias("reference_id"), F.col("class").alias("label"))
    return H.neighbour_votes(_near(spark, sf_dir, 5), labels).select("query_id", "predicted", F.round("average", 6).alias("average"))


@query(f"WITH {_NEAR}, m AS (SELECT query_id, k, avg(s.f[k]) AS made FROM p JOIN s ON s.ord = reference_id, (SELECT unnest(range(1, 65)) AS k) WHERE rank <= 3 GROUP BY 1, 2) SELECT (SELECT count(*) FROM s) AS n, round(1 - sum((s.f[k] - made) ** 2) / (SELECT sum(var_pop) FROM (SELECT var_pop(f[k]) * count(*) AS var_pop FROM s, (SELECT unnest(range(1, 65)) AS k) GROUP BY k)), 6) + 0.0 AS explained FROM m JOIN s ON s.ord = query_id")
def explained_by_neighbours(spark, sf_dir):
    """The share of variance that the mean of the three nearest explains."""
    return _reconstructed(spark, sf_dir, "mean")


@query()
def explained_by_local_fits(spark, sf_dir):
    return _reconstructed(spark, sf_dir, "linear")


def _reconstructed(spark, sf_dir, kind: str) -> DataFrame:
    rows = thousandths(spark, sf_dir)
    reference = rows.select(F.col("sample_id").alias("reference_id"), "features", F.col("features").alias("input"))
    queries = rows.select(F.col("sample_id").alias("query_id"), "features")
    made = I.from_neighbours(_near(spark, sf_dir, 3), queries, reference, kind)
    return I.explained_by(made.join(queries, "query_id"), "features", "made").select("n", r(F.col("explained")).alias("explained"))


@query(f"WITH {VECTORS}, l AS (SELECT ord, i, x[i] AS x FROM x, k64), q AS (SELECT ord, k, x[a] * x[b] AS v FROM x, k2), c2 AS (SELECT k, i, covar_pop(v, l.x) AS c, var_pop(v) AS v FROM q JOIN l USING (ord) GROUP BY 1, 2) SELECT k::INT AS place, round(sum(c * c / v) / (SELECT sum(w) FROM (SELECT var_pop(x) AS w FROM l GROUP BY i)), 6) + 0.0 AS explained FROM c2 GROUP BY k")
def explained_by_each_monomial(spark, sf_dir):
    """The share of the vectors' variance that each monomial of degree 2 explains by itself."""
    joint, n = S.joint_moments(whole(spark, sf_dir), expand(F.col("features"), SIZE, "QT"), F.col("features"))
    rows = [(k, float(v)) for k, v in enumerate(S.explained_by_each(joint, n))]
    return spark.createDataFrame(rows, "place int, explained double").select("place", r(F.col("explained")).alias("explained"))


@query()
def ranked_expansion(spark, sf_dir):
    """Components of an expansion in the order in which they explain the class best."""
    rows = whole(spark, sf_dir)
    ranked = S.rank_expansion(rows, ("identity", "u08"), 10, F.array(F.col("class").cast("double")))
    return spark.createDataFrame([(k, x.place, x.gain, x.explained) for k, x in enumerate(ranked)], "rank int, place int, gain double, explained double")


@query()
def expansion_search(spark, sf_dir):
    rows = whole(spark, sf_dir)
    choices = {"linear": ("identity",), "powers": ("identity", "u08"), "neighbours": ("identity", "product_adj4")}
    return spark.createDataFrame(S.search_expansions(rows, choices, F.array(F.col("class").cast("double"))), "choice string, size int, explained double")


@query()
def adapted_sigmoid_features(spark, sf_dir):
    rows = whole(spark, sf_dir)
    model = S.adapt_sigmoids(rows, "classification", 96, 4, key=F.col("class"))
    return long_rows(E.map_vectors(rows, model), "features", 6)


@query()
def network_inversion(spark, sf_dir):
    """Vectors near the samples for which a network gives half its outputs."""
    rows = whole(spark, sf_dir)
    trained, out = N.train_network(rows, N.NETWORKS["shared_two_layers"], "class")
    both = rows.join(out.select("sample_id", F.transform("features", lambda v: v / 2).alias("_wanted")), "sample_id")
    return long_rows(I.network_inverse(trained, both, F.col("_wanted")), "inverted", 6)


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def price_regression(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.array("l_quantity").alias("features"), "l_extendedprice")
    m = E.fit_regression(rows, F.col("l_extendedprice"))
    slope = float(m.weights[0, 0])
    return spark.createDataFrame([(slope, float(m.shift[0] - m.mean[0] * slope))], "slope double, intercept double").select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


def guesses(spark, sf_dir):
    """Quantities guessed from prices."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("truth"), F.floor(F.col("l_extendedprice") / 2000).cast("double").alias("guess"))


_GUESS = "g AS (SELECT l_quantity AS truth, floor(l_extendedprice / 2000) AS guess FROM lineitem)"


@query(f"WITH {_GUESS} SELECT round(avg(abs(truth - guess)), 6) AS mae, round(avg((truth - guess) ** 2), 6) AS mse, round(sqrt(avg((truth - guess) ** 2)), 6) AS rmse, round(avg((truth::BIGINT = guess::BIGINT)::INT), 6) AS rate FROM g")
def error_measures(spark, sf_dir):
    t, g = F.col("truth"), F.col("guess")
    return guesses(spark, sf_dir).agg(*[F.round(x, 6).alias(n) for n, x in (("mae", H.mean_absolute_error(t, g)), ("mse", H.mean_squared_error(t, g)), ("rmse", H.root_mean_squared_error(t, g)), ("rate", H.classification_rate(t, g)))])


@query(f"WITH {_GUESS}, m AS (SELECT truth AS m FROM (SELECT truth, row_number() OVER (ORDER BY truth) - 1 AS p, count(*) OVER () AS n FROM g) WHERE p = n // 2) SELECT round(stddev_pop(truth), 6) AS rmse, round(avg(abs(truth - m)), 6) AS mae FROM g, m")
def chance_levels(spark, sf_dir):
    return H.chance_levels(guesses(spark, sf_dir), "truth").select(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"))


@query(f"WITH {_GUESS} SELECT j::INT AS error, round(avg((abs(truth - guess) <= j)::INT), 6) AS score FROM g, (SELECT unnest(range(0, 31)) AS j) GROUP BY j")
def cumulative_scores(spark, sf_dir):
    return H.cumulative_scores(guesses(spark, sf_dir), F.col("truth"), F.col("guess")).select("error", F.round("score", 6).alias("score"))


@query(f"WITH {_GUESS} SELECT truth, count(*) AS n, round(avg(abs(guess - truth)), 6) AS mae, round(avg(guess), 6) AS mean_guess, round(avg(guess - truth), 6) + 0.0 AS bias FROM g GROUP BY truth")
def errors_by_label(spark, sf_dir):
    rows = H.error_table(guesses(spark, sf_dir), "truth", "guess")
    return rows.select("truth", "n", F.round("mae", 6).alias("mae"), F.round("mean_guess", 6).alias("mean_guess"), r(F.col("bias")).alias("bias"))


@query("SELECT quality AS truth, 1 - toxic AS guess, count(*) AS n FROM labels GROUP BY 1, 2")
def label_confusion(spark, sf_dir):
    return H.confusion(table(spark, sf_dir, "labels").withColumn("g", 1 - F.col("toxic")), "quality", "g")


@query("""WITH m AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS a FROM orders GROUP BY 1), k AS (SELECT p, a, row_number() OVER (ORDER BY a) - 1 AS class, lag(a) OVER (ORDER BY a) AS b, lead(a) OVER (ORDER BY a) AS c FROM m)
SELECT o_orderkey, class::INT AS class FROM orders JOIN k ON (b IS NULL OR o_totalprice > (a + b) / 2) AND (c IS NULL OR o_totalprice <= (a + c) / 2)""")
def nearest_class_label(spark, sf_dir):
    """Orders to the priority whose mean price is nearest, priorities counted in order of it."""
    rows = table(spark, sf_dir, "orders")
    means = sorted(x["label"] for x in H.class_labels(rows, "o_orderpriority", "o_totalprice").collect())
    return rows.select("o_orderkey", H.label_to_class(F.col("o_totalprice"), means, list(range(len(means)))).alias("class"))


@query("SELECT vec_id AS sample_id, label AS class FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) WHERE p <= 20")
def at_most_per_class(spark, sf_dir):
    return synthetic.at_most_per_class(whole(spark, sf_dir), 20).select("sample_id", "class")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def without_identities(spark, sf_dir):
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return synthetic.without_identities(table(spark, sf_dir, "customer"), held, "c_custkey").select("c_custkey")


@query("WITH a AS (SELECT c_nationkey AS n, row_number() OVER (ORDER BY c_nationkey) - 1 AS i FROM (SELECT DISTINCT c_nationkey FROM customer)), b AS (SELECT c_mktsegment AS m, row_number() OVER (ORDER BY c_mktsegment) - 1 AS i FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT a.i + (SELECT count(*) FROM a) * b.i AS ord, 'nation' || n || '_segment' || b.i || '_' || m || '.jpg' AS file FROM a, b")
def factor_files(spark, sf_dir):
    """A file name for each nation and segment that customers have."""
    found = table(spark, sf_dir, "customer")
    nations, segments = (sorted(x[0] for x in found.select(c).distinct().collect()) for c in ("c_nationkey", "c_mktsegment"))
    grid = synthetic.factor_grid(spark, nation=len(nations), segment=len(segments))
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(at).cast("int") + 1)
    grid = grid.withColumn("key", pick(nations, "nation")).withColumn("name", pick(segments, "segment"))
    return synthetic.file_names(grid, "nation%d_segment%d_%s.jpg", "key", "segment", "name").select("ord", "file")


@query(f"WITH {S64}, p AS (SELECT o.x + 4 * o.y AS node_id, (o.y * 2 + b) * 8 + o.x * 2 + a AS input FROM (SELECT x, y FROM (SELECT unnest(range(0, 4)) AS x), (SELECT unnest(range(0, 4)) AS y)) o, (SELECT unnest(range(0, 2)) AS a), (SELECT unnest(range(0, 2)) AS b)) SELECT ord, node_id::INT AS node_id, sum(f[input + 1]) + 0.0 AS total FROM s, p GROUP BY 1, 2")
def lattice_inputs(spark, sf_dir):
    """What each field of a lattice over an 8 x 8 grid sees of every vector, added up."""
    layer = N.Layer(tuple(tuple(c) for c in N.lattice_connections(8, 8, 2, 2, 2, 2)))
    return N.fields(thousandths(spark, sf_dir), layer).select(F.col("sample_id").alias("ord"), "node_id", (V.total(F.col("features")) + 0.0).alias("total"))


# Learnt models: rows only; tests hold their invariants.


def slow_model(rows: DataFrame, outputs: int = 9) -> E.Linear:
    return E.slow_features(M.train(rows, "classification", key=F.col("class")), outputs)


@query()
def classify_slow_features(spark, sf_dir):
    """The share of samples whose nine slowest features lie nearest their own class's mean."""
    rows = whole(spark, sf_dir)
    slow = E.map_vectors(rows, slow_model(rows))
    guessed = H.nearest_mean(slow, H.class_means(slow))
    return guessed.agg(F.count("*").alias("n"), F.round(H.classification_rate(F.col("class"), F.col("predicted")), 6).alias("rate"))


@query()
def slow_features(spark, sf_dir):
    rows = whole(spark, sf_dir)
    return long_rows(E.map_vectors(rows, slow_model(rows)), "features", 6)


@query()
def principal_components(spark, sf_dir):
    rows = whole(spark, sf_dir)
    return long_rows(E.map_vectors(rows, E.principal_components(M.train(rows, "unlabeled"), 0.5)), "features", 6)


@query()
def whitened(spark, sf_dir):
    rows = whole(spark, sf_dir)
    return long_rows(E.map_vectors(rows, E.principal_components(M.train(rows, "unlabeled"), 8, whiten=True)), "features", 6)


def covariances(rows: DataFrame) -> DataFrame:
    """(i, j, covariance) of the vectors, by sums over all pairs of components."""
    cells = rows.select(F.explode(F.flatten(F.transform("features", lambda a, i: F.transform("features", lambda b, j: F.struct(i.alias("i"), j.alias("j"), a.alias("a"), b.alias("b")))))).alias("c"))
    return cells.groupBy("c.i", "c.j").agg(F.covar_pop("c.a", "c.b").alias("covariance")).select("i", "j", r(F.col("covariance")).alias("covariance"))


@query("SELECT a.i::INT AS i, b.i::INT AS j, (a.i = b.i)::INT::DOUBLE AS covariance FROM (SELECT unnest(range(0, 8)) AS i) a, (SELECT unnest(range(0, 8)) AS i) b")
def covariance_of_whitened(spark, sf_dir):
    """One on the diagonal, else none."""
    rows = whole(spark, sf_dir)
    return covariances(E.map_vectors(rows, E.principal_components(M.train(rows, "unlabeled"), 8, whiten=True)))


@query("SELECT a.i::INT AS i, b.i::INT AS j, (a.i = b.i)::INT::DOUBLE AS covariance FROM (SELECT unnest(range(0, 9)) AS i) a, (SELECT unnest(range(0, 9)) AS i) b")
def covariance_of_slow_features(spark, sf_dir):
    rows = whole(spark, sf_dir)
    return covariances(E.map_vectors(rows, slow_model(rows)))


@query(f"WITH {LONG}, w AS (SELECT var_pop(x) AS w FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i) SELECT (SELECT count(*) FROM s) AS n, round(sum(w), 6) AS variance FROM w")
def variance_of_principal_components(spark, sf_dir):
    """All components together have the variance of the vectors."""
    rows = whole(spark, sf_dir)
    y = E.map_vectors(rows, E.principal_components(M.train(rows, "unlabeled")))
    each = y.select(F.posexplode("features").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("w"), F.count("*").alias("n"))
    return each.agg(F.max("n").alias("n"), F.round(F.sum("w"), 6).alias("variance"))


@query()
def slow_features_and_rest(spark, sf_dir):
    rows = whole(spark, sf_dir)
    model = E.fit_slow_and_rest(rows, "classification", names=("identity", "u08"), delta_threshold=1.98, key=F.col("class"))
    return long_rows(model.apply(rows), "features", 6)


@query()
def gaussian_classes(spark, sf_dir):
    rows = whole(spark, sf_dir)
    probabilities, classes = H.gaussian_classifier(rows, SIZE)
    p = H.with_probabilities(rows, probabilities)
    label = F.round(H.expected_label(F.col("p"), classes), 6)
    return p.select("sample_id", "class", label.alias("expected"), H.median_label(F.col("p"), classes).alias("median"))


@query(f"""WITH {S64}, p AS (SELECT vec_id AS ord, [v::DOUBLE * v for v in embedding] AS q FROM embeddings), t AS (SELECT ord, i, q[i] / list_sum(q) AS p FROM p, k64),
a AS (SELECT ord, i, p, sum(p) OVER (PARTITION BY ord ORDER BY i) AS s FROM t), f AS (SELECT ord, min(i) AS i FROM a WHERE s > 0.5 GROUP BY 1)
SELECT ord AS sample_id, round(CASE WHEN i = 1 THEN 0 ELSE ((i - 1) * (i - 1) + (i - 2) * (i - 2)) / 2.0 END + (CASE WHEN i = 1 THEN -0.5 ELSE 0 END) + (0.5 - (s - p)) / p * (CASE WHEN i = 1 THEN 1 WHEN i = 64 THEN 63 * 63 - 62 * 62 ELSE (i * i - (i - 2) * (i - 2)) / 2.0 END), 6) + 0.0 AS label
FROM f JOIN a USING (ord, i)""")
def bar_median_labels(spark, sf_dir):
    """Squared components as probabilities of classes with the labels 0, 1, 4, 9, ..."""
    x = F.col("features")
    rows = whole(spark, sf_dir).withColumn("p", F.transform(x, lambda v: v * v / V.dot(x, x)))
    return rows.select("sample_id", r(H.bar_median_label(F.col("p"), [float(k * k) for k in range(SIZE)])).alias("label"))


@query()
def slow_beside_components(spark, sf_dir):
    """Learnt from two halves of the samples, one after the other."""
    rows = whole(spark, sf_dir)
    learner = E.SlowBesideComponents(("identity", "u08"), 9, scaling="data_dependent2")
    for half in (0, 1):
        learner.train(rows.where(F.col("ord") % 2 == half), "classification", key=F.col("class"))
    return long_rows(learner.finish().apply(rows), "features", 6)


@query()
def two_layer_network(spark, sf_dir):
    rows = whole(spark, sf_dir)
    return long_rows(N.train_network(rows, N.NETWORKS["two_layers"], "class")[1], "features", 6)


@query()
def shared_weights_network(spark, sf_dir):
    rows = whole(spark, sf_dir)
    return long_rows(N.train_network(rows, N.NETWORKS["shared_two_layers"], "class")[1], "features", 6)


@query()
def label_graph_slow_features(spark, sf_dir):
    """Slow features of the graph that the labels alone define; its edges are never made."""
    rows = G.free_responses(whole(spark, sf_dir), [F.col("class")], F.lit(1.0)).withColumn("v", F.lit(1.0))
    m = G.label_moments(rows, SIZE, [0.0])
    return long_rows(E.map_vectors(rows.select("sample_id", "features"), E.slow_features(m, 2)), "features", 6)


@query(f"WITH m AS (SELECT count(*) AS n, count(*) // {BLOCK} - 1 AS last FROM embeddings), d AS (SELECT 2 - 2 * cos(pi() * j / last) AS delta FROM m, LATERAL (SELECT unnest(range(0, last + 1)) AS j) UNION ALL SELECT 2.0 FROM m, LATERAL (SELECT unnest(range(last + 1, n)))) SELECT (row_number() OVER (ORDER BY delta) - 1)::INT AS k, round(delta, 6) + 0.0 AS delta FROM d")
def graph_responses(spark, sf_dir):
    """Deltas of all free responses of a serial graph; those of a chain of blocks have a closed form. No matrix of the graph is made. Samples after the last whole block are tied to none."""
    n = number(spark, sf_dir)
    nodes, edges = G.serial(spark, n // BLOCK * BLOCK, BLOCK)
    q, w = nodes.agg(F.sum("v")).first()[0], edges.agg(F.sum("w")).first()[0]
    alone = spark.range(n // BLOCK * BLOCK, n).select(F.col("id").alias("sample_id"), F.lit(1.0).alias("v"))
    return SP.chain_spectrum(nodes.union(alone), edges).select(F.col("k").cast("int").alias("k"), r(2 - 2 * F.col("value") * q / w).alias("delta"))


@query()
def nonlinear_components(spark, sf_dir):
    rows = whole(spark, sf_dir)
    stages = E.nonlinear_components(rows, SIZE, 2)
    return spark.createDataFrame([(k, float(a.values[0])) for k, (a, _) in enumerate(stages)], "k int, variance double")


@query()
def random_latent_source(spark, sf_dir):
    """As many random samples as there are vectors."""
    return synthetic.splits(synthetic.random_latent(spark, number(spark, sf_dir), 16)).groupBy("class", "split").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("label"))


_W = np.round(np.random.default_rng(0).normal(size=(SIZE, 6)), 6)
_OFFSETS = [0.1, 0.2, 0.8, 1.0, -0.3, 0.0]


@query(long_sql(" UNION ALL ".join(
    f"SELECT ord, {j}{' AS k' if not j else ''}, {f'pow(abs({y}), 0.8)' if o == 0.8 else y if o == 1.0 else f'tanh({y} + {o})'}{' AS v' if not j else ''} FROM x"
    for j, o in enumerate(_OFFSETS) for y in [f"list_sum([z[1] * z[2] for z in list_zip(x, {_W[:, j].tolist()}::DOUBLE[])])"])))
def sigmoid_expansion(spark, sf_dir):
    return long_rows(whole(spark, sf_dir).withColumn("y", sigmoid_features(_W.tolist(), _OFFSETS)(F.col("features"), SIZE)))


# Cut-offs under rotations, chunks, parts and blocks, linear views.

#: Pairs of components turned by the angle of the triangle 3, 4, 5.
_TURN = np.kron(np.eye(SIZE // 2), np.array([[0.6, -0.8], [0.8, 0.6]]))


@query(f"""WITH {LONG}, y0 AS (SELECT i, min(x) AS low, max(x) AS high, avg(x) AS mean, stddev_pop(x) AS spread FROM l WHERE class < 2 GROUP BY i),
turned AS (SELECT a.ord, a.class, a.i AS i, 0.6 * a.x + 0.8 * b.x AS y, b.i AS j, -0.8 * a.x + 0.6 * b.x AS z FROM l a JOIN l b ON b.ord = a.ord AND b.i = a.i + 1 WHERE a.i % 2 = 1),
y1 AS (SELECT i, min(y) AS low, max(y) AS high FROM turned WHERE class < 2 GROUP BY i UNION ALL SELECT j, min(z), max(z) FROM turned WHERE class < 2 GROUP BY j),
c0 AS (SELECT ord, i, x, least(greatest(x, low), high) AS y, high - low AS wide, -0.5 * ((x - mean) / (4 * spread)) ** 2 - ln(4 * spread * sqrt(2 * pi())) AS normal FROM l JOIN y0 USING (i)),
t1 AS (SELECT a.ord, a.i AS i, 0.6 * a.y + 0.8 * b.y AS y FROM c0 a JOIN c0 b ON b.ord = a.ord AND b.i = a.i + 1 WHERE a.i % 2 = 1 UNION ALL SELECT a.ord, b.i, -0.8 * a.y + 0.6 * b.y FROM c0 a JOIN c0 b ON b.ord = a.ord AND b.i = a.i + 1 WHERE a.i % 2 = 1),
c1 AS (SELECT ord, i, y AS x, least(greatest(y, low), high) AS y, high - low AS wide FROM t1 JOIN y1 USING (i)),
n1 AS (SELECT c0.ord, sum(-0.5 * ((c0.y - mean) / (4 * spread)) ** 2 - ln(4 * spread * sqrt(2 * pi()))) AS normal FROM c0 JOIN y0 USING (i) GROUP BY 1),
f AS (SELECT ord, product(1 - pow((abs(y - x) / wide) / (abs(y - x) / wide + 0.15), 2)) AS f FROM (SELECT ord, x, y, wide FROM c0 UNION ALL SELECT ord, x, y, wide FROM c1) GROUP BY 1),
g AS (SELECT ord, sum(normal) AS normal FROM c0 GROUP BY 1), q AS (SELECT ord, sum(y * y) AS q FROM c1 GROUP BY 1)
SELECT ord, round(f, 6) AS correction, round((g.normal + n1.normal) / {UNIT}, 4) AS log_normal, round(q / {UNIT}, 1) AS square FROM f JOIN g USING (ord) JOIN n1 USING (ord) JOIN q USING (ord)""")
def rotated_cut_off(spark, sf_dir):
    """All samples cut to the bounds of classes 0 and 1, as they are and turned; how unusual each is, and its squared length after."""
    rows = thousandths(spark, sf_dir)
    out = CO.apply_cut_off(rows, CO.fit_cut_off(rows.where("class < 2"), (np.eye(SIZE), _TURN)))
    square = F.aggregate("features", F.lit(0.0), lambda s, v: s + v * v)
    return out.select(F.col("sample_id").alias("ord"), F.round("correction", 6).alias("correction"), r(F.col("log_normal") / UNIT, 4).alias("log_normal"), r(square / UNIT, 1).alias("square"))


@query("WITH b AS (SELECT vec_id AS ord, vec_id // 4 AS b, max(vec_id) OVER () AS last FROM embeddings), c AS (SELECT ord, b // 5 AS chunk FROM b UNION ALL SELECT ord, b // 5 - 1 FROM b WHERE b % 5 = 0 AND b > 0), k AS (SELECT c.chunk, c.ord FROM c, (SELECT any_value(last) AS last FROM b) WHERE c.chunk * 20 + 4 <= last OR c.chunk = 0) SELECT chunk, count(*) AS n, min(ord) AS first, max(ord) AS last FROM k GROUP BY 1")
def overlapping_chunks(spark, sf_dir):
    """Chunks of six blocks of four samples, each of which begins with the last block of the one before."""
    rows = chunked(whole(spark, sf_dir), 6, 4, continuous=True)
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"))


@query("WITH z AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), p AS (SELECT label::INT AS class, part::INT AS part, (n + 2 - part) // 3 AS n FROM z, (SELECT unnest(range(0, 3)) AS part)) SELECT class, part, n, n * greatest(n - 1, 1) AS edges, 0::BIGINT AS inconsistent FROM p WHERE n > 0")
def parts_of_classes(spark, sf_dir):
    """Three parts of the samples, each with an even share of every class and its own consistent graph."""
    rows = GB.split_groups(whole(spark, sf_dir), F.col("class"), 3)
    out = None
    for part in range(3):
        mine = rows.where(F.col("part") == part)
        nodes, edges = GB.part_graph(rows, part, F.col("class"))
        bad = G.consistency(nodes, edges).where("not consistent").count()
        ends = edges.join(mine.select(F.col("sample_id").alias("src"), "class"), "src").groupBy("class").agg(F.count("*").alias("edges"))
        one = mine.groupBy("class").agg(F.count("*").alias("n")).join(ends, "class").select("class", F.lit(part).alias("part"), "n", "edges", F.lit(bad).cast("long").alias("inconsistent"))
        out = one if out is None else out.union(one)
    return out


@query(f"WITH x AS (SELECT 1){_RG}, b AS (SELECT src // 16 AS i, dst // 16 AS j, src, dst, w FROM g) SELECT i, j, count(*) AS n, sum(w) AS total, max(w) AS most FROM b GROUP BY 1, 2")
def graph_in_blocks(spark, sf_dir):
    """The suppliers' graph as dense blocks of 16 by 16: how many weights each holds, their sum and the largest."""
    blocks = GB.to_blocks(supplies(spark, sf_dir)[1], 16)
    some = F.filter("cells", lambda w: w != 0)
    return blocks.select("i", "j", F.size(some).cast("long").alias("n"), F.aggregate("cells", F.lit(0.0), lambda s, w: s + w).alias("total"), F.array_max("cells").alias("most"))


@query(f"WITH {LONG}, y AS (SELECT ord, sum(x * i) AS y FROM l WHERE i <= 3 GROUP BY 1), cv AS (SELECT i, covar_pop(x, y) AS c, var_pop(x) AS v, any_value((SELECT var_pop(y) FROM y)) AS w FROM l JOIN y USING (ord) GROUP BY i) SELECT round(sum(c * c) / any_value(w) / sum(v), 6) AS explained, round(sum((c / w) ** 2), 6) AS sensitivity FROM cv")
def linear_view_of_one_output(spark, sf_dir):
    """How much of the vectors a linear map gives back from one weighted sum of their first components, and how far it moves them."""
    x = F.col("features")
    view = LV.linear_view(thousandths(spark, sf_dir).withColumn("outputs", F.array(F.get(x, 0) + 2 * F.get(x, 1) + 3 * F.get(x, 2))))
    return spark.createDataFrame([(float(view.explained), float(view.sensitivity[0]))], "explained double, sensitivity double").select(r(F.col("explained")).alias("explained"), r(F.col("sensitivity")).alias("sensitivity"))


@query()
def probes_of_vectors(spark, sf_dir):
    """The share of samples whose class is told from 4 to 64 random sigmoids of the vectors."""
    rows = whole(spark, sf_dir)
    return LV.probe_classes(rows, [4, 16, 64])


@query("SELECT class, dim, count(*) AS n, 0::BIGINT AS wrong FROM (SELECT label::INT AS class, unnest(range(0, 8)) AS dim FROM embeddings) GROUP BY 1, 2")
def slots_network(spark, sf_dir):
    """A layer of four fields with every slot filled; of each class and output, how many samples there are and how many outputs are not finite."""
    layer = SL.SlotLayer(tuple(tuple(range(k, k + 16)) for k in range(0, SIZE, 16)), pca="PrincipalComponents", order="Ordering", expansions=("identity", "u08"), reduction="Whitening", parameters={"pca": {"outputs": 6}, "reduction": {"outputs": 5}, "outputs": 2, "ridge": 1e-6})
    rows = whole(spark, sf_dir)
    out = SL.apply_slots(rows, SL.train_slots(rows, layer, "class"))
    return out.select("class", F.posexplode("features").alias("dim", "v")).groupBy("class", F.col("dim").cast("long").alias("dim")).agg(F.count("*").alias("n"), F.sum(F.when(F.isnan("v") | (F.abs("v") == float("inf")), 1).otherwise(0)).alias("wrong"))


@query("WITH p AS (SELECT vec_id AS place, (vec_id * 7 + 3) % (SELECT count(*) // 2 FROM embeddings) AS spot FROM embeddings) SELECT place, vec_id AS ord, label::INT AS class FROM p JOIN embeddings ON vec_id = spot")
def rows_by_a_list(spark, sf_dir):
    """As many rows as there are, by a list of places in the first half of them."""
    rows = whole(spark, sf_dir)
    half = rows.count() // 2
    places = rows.select(F.col("ord").alias("place"), ((F.col("ord") * 7 + 3) % half).alias("ord"))
    return synthetic.rows_at(rows, places).select("place", "ord", "class")


@query("SELECT c::INT AS class, count(label) AS n FROM (SELECT unnest(range(0, 43)) AS c) LEFT JOIN embeddings ON label = c GROUP BY 1")
def histogram_of_classes(spark, sf_dir):
    return synthetic.class_histogram(whole(spark, sf_dir), 43)
