"""Readers and writers of the file formats that samples come in."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import ship

#: Header of a feature file: four little-endian 32-bit numbers: this one, iteration, rows, size.
FEATURE_MAGIC = 666
#: IDX types by their code: all big-endian.
IDX_TYPES = {8: "u1", 9: "i1", 11: ">i2", 12: ">i4", 13: ">f4", 14: ">f8"}


def _binary(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _vectors(name: str, x: np.ndarray, step: int = 4096) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(x), step):
        part = np.ascontiguousarray(x[a : a + step], float)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part))), rows], ["path", "row", "features"])


def _each_file(files: DataFrame, read) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from _vectors(name, read(blob.as_py()))

    return files.mapInArrow(run, "path string, row long, features array<double>")


def feature_matrix(blob: bytes) -> np.ndarray:
    magic, _, rows, size = np.frombuffer(blob, "<u4", 4).tolist()
    if magic != FEATURE_MAGIC:
        raise ValueError("not a feature file")
    return np.frombuffer(blob, "<f8", rows * size, 16).reshape(rows, size)


def feature_blob(x: np.ndarray, iteration: int = 0) -> bytes:
    return np.array([FEATURE_MAGIC, iteration, *x.shape], "<u4").tobytes() + np.ascontiguousarray(x, "<f8").tobytes()


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, features) of feature files: a header and float64 rows."""
    return _each_file(_binary(spark, path), feature_matrix)


def feature_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, iteration, rows, size) of feature files, by built-in functions."""
    number = lambda k: F.conv(F.hex(F.reverse(F.substring("content", 4 * k + 1, 4))), 16, 10).cast("long")
    return spark.read.format("binaryFile").load(path).select("path", number(1).alias("iteration"), number(2).alias("rows"), number(3).alias("size"))


def read_raw(spark: SparkSession, path: str, size: int, kind: str = "u1", scale: float = 1 / 255) -> DataFrame:
    """(path, row, features) of files of bare fixed-width rows; a length that is no multiple of the row raises."""

    def read(blob: bytes) -> np.ndarray:
        x = np.frombuffer(blob, kind)
        if len(x) % size:
            raise ValueError(f"{len(x)} values are not rows of {size}")
        return x.reshape(-1, size) * scale

    return _each_file(_binary(spark, path), read)


def idx_array(blob: bytes) -> np.ndarray:
    kind, sizes = IDX_TYPES[blob[2]], np.frombuffer(blob, ">u4", blob[3], 4).tolist()
    return np.frombuffer(blob, kind, int(np.prod(sizes)), 4 + 4 * blob[3]).reshape(sizes)


def read_idx(spark: SparkSession, images: str, labels: str | None = None, digits: Sequence[int] | None = None) -> DataFrame:
    """(row, features, class) of an IDX image file and its label file, of the given digits only."""
    rows = _each_file(_binary(spark, images), lambda b: idx_array(b).reshape(len(idx_array(b)), -1).astype(float)).select("row", "features")
    if labels is None:
        return rows
    named = _each_file(_binary(spark, labels), lambda b: idx_array(b).reshape(-1, 1).astype(float)).select("row", F.get("features", 0).cast("int").alias("class"))
    rows = rows.join(named, "row")
    return rows.where(F.col("class").isin(list(digits))) if digits is not None else rows


def read_annotations(spark: SparkSession, path: str, with_class: bool = True) -> DataFrame:
    """Semicolon-separated rows of file name, size, box corners and class."""
    schema = "Filename string, Width int, Height int, X1 int, Y1 int, X2 int, Y2 int" + ", ClassId int" * with_class
    return spark.read.option("sep", ";").option("header", True).schema(schema).csv(path)


def read_labels(spark: SparkSession, path: str, columns: str = "file string, age double, race string, gender string", sep: str = " ") -> DataFrame:
    return spark.read.option("sep", sep).schema(columns).csv(path)


def append_labels(files: DataFrame, labels: DataFrame, low: float | None = None, high: float | None = None, column: str = "age") -> DataFrame:
    """files with their labels, of labels in the range only."""
    keep = F.lit(True)
    keep = keep & (F.col(column) >= low) if low is not None else keep
    keep = keep & (F.col(column) <= high) if high is not None else keep
    return files.join(labels.where(keep), "file")


def read_text_features(spark: SparkSession, path: str) -> DataFrame:
    """(path, features): a file is a vector, a number a line."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.select("path", F.transform(F.filter(F.split("value", "\\s+"), lambda x: x != ""), lambda x: x.cast("double")).alias("features"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, directory) of the files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", "length", F.element_at(F.split("path", "/"), -2).alias("directory"))


def write_libsvm(samples: DataFrame, path: str, label: str = "label") -> None:
    """A line a sample: label, then i:value with i from 1."""
    samples.select(libsvm_line(F.col(label), F.col("features")).alias("value")).write.text(path)


def libsvm_line(label, features):
    """The line of a sample; zeros stand too."""
    return F.concat_ws(" ", label.cast("string"), F.array_join(F.transform(features, lambda v, i: F.concat((i + 1).cast("string"), F.lit(":"), v.cast("string"))), " "))


def write_text_matrix(samples: DataFrame, path: str, digits: int = 6) -> None:
    samples.select(F.array_join(F.transform("features", lambda v: F.format_string(f"%.{digits}f", v)), " ").alias("value")).write.text(path)


def write_chunks(samples: DataFrame, path: str, rows: int = 5000) -> None:
    """Parquet files of at most so many rows."""
    samples.write.option("maxRecordsPerFile", rows).parquet(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """(file, class) as ``file; class`` lines."""
    rows.select("file", "class").write.option("sep", ";").csv(path)
