"""Operator 12: plain Lloyd clustering of vectors in exact integers.

A component x becomes floor(64 * x), so that distances, sums and ties are
exact in any order. The centroids are a few hundred numbers and are broadcast
each round; tasks compare their vectors with each centroid in NumPy and keep
one row of integer sums for each centroid, which a groupBy adds up. A hot
cluster is thus one row a task, whatever its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import read_table, small_batches, stage, unstage

#: Components are multiplied by this before they are rounded down.
GRAIN = 64
#: Integer components of a larger size raise: their distances might not fit 64 bits.
LARGEST = 1 << 26


def finite(vector: Column) -> Column:
    """True where neither the vector nor a component is null, and every component is a finite number."""
    infinite = F.lit(float("inf"))
    each = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)
    return vector.isNotNull() & F.coalesce(F.forall(vector, each), F.lit(False))


def whole_numbers(vector: Column, grain: int, largest: int = LARGEST) -> Column:
    """floor(grain * x) of each component, computed as double; a result of over largest raises."""

    def one(x: Column) -> Column:
        y = F.lit(float(grain)) * x.cast("double")
        too_large = F.raise_error(F.concat(F.lit(f"a component times {grain} is not within {largest}: "), y.cast("string"))).cast("int")
        return F.when(F.abs(y) < largest, F.floor(y).cast("int")).otherwise(too_large)

    return F.transform(vector, one)


def vectors(table: DataFrame, size: int | None, grain: int, *also: str, largest: int = LARGEST) -> DataFrame:
    """(vec_id, also, v ARRAY<INT>) of the rows whose vector is finite and, if a size is given, has so many components."""
    x = F.col("embedding")
    rows = table.where(finite(x) & (F.size(x) == size)) if size is not None else table.where(finite(x))
    return rows.select("vec_id", *also, whole_numbers(x, grain, largest).alias("v"))


def first_centroids(kept: DataFrame, count: int, prefix: str = "1:") -> np.ndarray:
    """The vectors whose sha256 of prefix and vec_id come first, those without a vec_id last; fewer vectors, fewer centroids. Of equal vec_ids the lesser vector comes first."""
    name = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.select(name.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(count).collect()
    return np.array([r["v"] for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest number of the nearest centroids and the squared distance to it, of each row of x."""
    d = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        away = x - c
        d[:, k] = (away * away).sum(axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64)


def _sums(centroids: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if len(batch):
                x = _matrix(batch["v"])
                best, _ = nearest(x, centroids)
                n += np.bincount(best, minlength=len(n))
                np.add.at(total, best, x)
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "total": list(total[some])})

    return run


def lloyd_round(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after all vectors have gone to the nearest: floors of the exact means; one without vectors stays."""
    parts = kept.select("v").mapInPandas(_sums(centroids), "cluster int, n long, total array<long>")
    wide = [F.sum(F.get("total", i).cast("decimal(20,0)")).alias(f"t{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():  # a row for each centroid
        out[r["cluster"]] = [int(r[f"t{i}"]) // r["n"] for i in range(centroids.shape[1])]
    return out


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    kind = kept.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                best, d = nearest(_matrix(batch["v"]), centroids)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": best.astype(np.int32), "distance": d})

    named = kept.select(F.col("vec_id").cast("string").alias("vec_id"), "v")  # pandas would make doubles of ids beside nulls
    return named.mapInPandas(run, "vec_id string, cluster int, distance long").withColumn("vec_id", F.col("vec_id").cast(kind))


def digest(numbers: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, np.asarray(numbers).reshape(-1).tolist())).encode()).hexdigest()


def lloyd(table: DataFrame, clusters: int = 16, rounds: int = 3, size: int = 64, grain: int = GRAIN) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept row of table (vec_id, embedding; other columns are ignored).

    Rows are kept whose embedding has exactly size components, none of them
    null or not finite. Repeated rows count as often as they stand. Rows
    without a vec_id are first centroids only after all others. With fewer
    rows than clusters there are fewer centroids; with none, or an empty
    table, no rows come out. Ties go to the lowest number. A component of
    over 2**26 times 1 / grain raises.
    """
    spark = table.sparkSession
    small_batches(spark)
    kept = stage(vectors(table, size, grain), "vectors")
    centroids = first_centroids(kept, clusters)
    if not len(centroids):
        unstage(kept)
        return spark.createDataFrame([], f"vec_id {table.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = lloyd_round(kept, centroids)
    found = stage(assign(kept, centroids), "assigned")
    unstage(kept)
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    at = F.col("cluster") + 1
    own = F.element_at(F.array(*[F.lit(inertia.get(k, 0)).cast("long") for k in range(len(centroids))]), at)
    name = F.element_at(F.array(*[F.lit(digest(c)) for c in centroids]), at)
    return found.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), name.alias("centroid_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd(read_table(spark, sf_dir, "embeddings"))


def _sql(clusters: int = 16, rounds: int = 3, size: int = 64, grain: int = GRAIN) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS (SELECT vec_id, v, min(d) AS distance, arg_min(cluster, (d, cluster)) AS cluster FROM "
            f"(SELECT vec_id, v, cluster, list_sum([(v[i] - c[i]) * (v[i] - c[i]) for i in range(1, {size + 1})])::BIGINT AS d FROM x, c{k}) GROUP BY vec_id, v)"
        )
        if k < rounds:
            steps.append(
                f"m{k} AS (SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY 1, 2), "
                f"n{k} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{k} GROUP BY 1), "
                f"c{k + 1} AS (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN n{k} n USING (cluster))"
            )
    return (
        f"WITH x AS MATERIALIZED (SELECT vec_id, [floor({grain} * e::DOUBLE)::BIGINT for e in embedding] AS v FROM embeddings "
        f"WHERE len(embedding) = {size} AND len([e for e in embedding if isfinite(e)]) = {size}), "
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v AS c FROM (SELECT v, sha256('1:' || vec_id) AS h FROM x ORDER BY h LIMIT {clusters})), "
        + ", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)
        + f" SELECT vec_id, a.cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"
    )


#: Distinct vec_ids, as the given table has them.
OP12_SQL = _sql()
