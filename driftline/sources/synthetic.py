"""Sources that need no files, and datasets by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import ship


def random_latent(spark: SparkSession, rows: int, size: int = 64, seed: int = 0, noise: float = 0.1) -> DataFrame:
    """(sample_id, ord, features, label, class): vectors in 0 to 255 from a label in 0 to 1, by a fixed mixing and noise.

    A row depends on its id and the seed only, so a task that runs again makes the same rows.
    """
    ship(spark)
    mixing = np.random.default_rng(seed).normal(size=(3, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            label = (ids + 0.5) / rows
            latent = np.stack([label, np.sin(2 * np.pi * label), np.cos(2 * np.pi * label)], axis=1)
            jitter = np.stack([np.random.default_rng([seed, int(i)]).normal(size=size) for i in ids]) if len(ids) else np.zeros((0, size))
            x = np.clip(latent @ mixing * 0.2 + 0.5 + noise * jitter, 0, 1) * 255
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * size), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("id"), flat, pa.array(label), pa.array(np.minimum(label * 10, 9).astype(np.int32))], ["sample_id", "ord", "features", "label", "class"])

    return spark.range(rows).mapInArrow(run, "sample_id long, ord long, features array<double>, label double, class int")


def factor_grid(spark: SparkSession, **factors: int) -> DataFrame:
    """Every combination of factors (name: number of values), ord rising with the last named one slowest."""
    out = spark.range(1).select(F.lit(0).cast("long").alias("ord"))
    step = 1
    for name, n in factors.items():
        out = out.crossJoin(F.broadcast(spark.range(n).select(F.col("id").alias(name))))  # factors are short lists
        out = out.withColumn("ord", F.col("ord") + F.col(name) * step)
        step *= n
    return out


def file_names(grid: DataFrame, pattern: str, *columns: str) -> DataFrame:
    return grid.withColumn("file", F.format_string(pattern, *[F.col(c) for c in columns]))


def embeddings(spark: SparkSession, sf_dir: str, size: int | None = None, grain: float | None = None) -> DataFrame:
    """The embeddings table as samples (sample_id, ord, class, features), the first components of it, as whole multiples of the grain."""
    x = F.col("embedding").cast("array<double>")
    x = F.slice(x, 1, size) if size else x
    x = F.transform(x, lambda v: F.round(v / grain) + 0.0) if grain else x
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), F.col("vec_id").alias("ord"), F.col("label").cast("int").alias("class"), x.alias("features"))


DATASETS: dict[str, Callable[..., DataFrame]] = {"random_latent": random_latent, "embeddings": embeddings}


def register(name: str, source: Callable[..., DataFrame]) -> None:
    """Makes a dataset known by a name."""
    DATASETS[name] = source


def dataset(spark: SparkSession, name: str, *args, **options) -> DataFrame:
    if name not in DATASETS:
        raise ValueError(f"no dataset is called {name}; there are {', '.join(sorted(DATASETS))}")
    return DATASETS[name](spark, *args, **options)


def splits(samples: DataFrame, seed: int = 0, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """samples with split: train, supervised or test, by a hash of sample_id."""
    u = F.pmod(F.xxhash64("sample_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return samples.withColumn("split", F.when(u < shares[0], "train").when(u < sum(shares), "supervised").otherwise("test"))


def at_most_per_class(samples: DataFrame, most: int, key: str = "class") -> DataFrame:
    """The first most samples of each class, by sample_id."""
    from pyspark.sql import Window as W

    return samples.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("sample_id"))).where(F.col("_n") <= most).drop("_n")


def repeated(samples: DataFrame, times: int) -> DataFrame:
    """Every sample so many times, with copy from 0."""
    return samples.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def random_subset(samples: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k samples without replacement; more than there are raise."""
    if k > samples.count():
        raise ValueError(f"there are not {k} samples")
    return samples.orderBy(F.xxhash64("sample_id", F.lit(seed)), "sample_id").limit(k)


def without_identities(samples: DataFrame, held: DataFrame, key: str = "identity") -> DataFrame:
    """samples of identities that held does not have."""
    return samples.join(held.select(key).distinct(), key, "left_anti")


def fingerprint(samples: DataFrame) -> DataFrame:
    """(n, digest): the same for the same rows in any order."""
    row = F.xxhash64("sample_id", F.to_json(F.struct("features")))
    return samples.agg(F.count("*").alias("n"), F.hex(F.bit_xor(row)).alias("digest"))


def rows_at(samples: DataFrame, places: DataFrame) -> DataFrame:
    """The samples (ord) that places (place, ord) names, with place: in any order, as often as they are named; an ord that is not there gives no row."""
    return samples.join(places.select("place", F.col("ord").alias("_at")), F.col("ord") == F.col("_at")).drop("_at")


def class_histogram(samples: DataFrame, classes: int, key: str = "class") -> DataFrame:
    """(class, n) of the classes 0, 1, ..., those without a sample with 0; other values of key are left out."""
    every = samples.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    found = samples.groupBy(F.col(key).cast("int").alias("_c")).agg(F.count("*").alias("n"))
    return every.join(F.broadcast(found.where(F.col("_c").between(0, classes - 1))), F.col("class") == F.col("_c"), "left").select("class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def coin(*of: str, seed: int = 0) -> Column:
    """True or false by a fair hash of the named columns: the same for a row that is made again."""
    return F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(2)) == 1


def gender_code(gender: Column) -> Column:
    """A number from -4 to 4 as 0 to 999; null as 999."""
    return F.when(gender.isNull(), 999).otherwise(F.least(F.greatest((500 + gender * 125).cast("int"), F.lit(0)), F.lit(999)))
