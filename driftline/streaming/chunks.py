"""Long series cut into chunks, and moments over chunks that equal those of the whole.

A chunk's differences to the one before need that one's last rows. They are
kept in a table beside the states: the moments of the kept rows and the chunk
together, less those of the kept rows alone, are what the chunk adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline.operators.moments import Moments, matrix, merge, neighbourhoods


def chunked(samples: DataFrame, chunk_size: int, block: int = 1, continuous: bool = False) -> DataFrame:
    """samples (ord from 0) with chunk: chunks of chunk_size blocks. Continuous ones begin with the last block of the one before, so such a block is in two.

    A chunk has two blocks at least; the last one may be shorter. A last chunk
    that would only repeat a block is left out.
    """
    size = max(chunk_size, 2)
    at = F.floor(F.col("ord") / block)
    if not continuous:
        return samples.withColumn("chunk", F.floor(at / size))
    step = size - 1
    first = F.floor(at / step)
    # A block at a multiple of the step ends one chunk and begins the next, if that one has more.
    last = samples.agg(F.max("ord")).first()[0]
    more = F.lit(-1 if last is None else last) >= (at + 1) * block
    both = F.when((at % step == 0) & (at > 0), F.when(more, F.array(first - 1, first)).otherwise(F.array(first - 1))).otherwise(F.array(first))
    return samples.withColumn("chunk", F.explode(both))


def pair_states(samples: DataFrame, size: int, width: int) -> DataFrame:
    """(state) of samples with weight 1 and of all pairs up to width apart in order, weight 1."""

    def work(x: np.ndarray, at: np.ndarray, own: np.ndarray) -> Moments:
        state = Moments.zero(size)
        state.nodes(x[own])
        for d in range(1, width + 1):
            for k in range(1, width + 1):  # k rows apart in the batch and d in order
                if k < len(at):
                    state.edges((x[k:] - x[:-k])[own[:-k] & (at[k:] - at[:-k] == d)])
        return state

    return neighbourhoods(samples, width, work)


class ChunkFold:
    """Moments folded over chunks that come in order, kept in tables under a path: states, the last rows, and rows that came late.

    width: how far apart tied samples are; 1 for the mode regular. A row whose
    ord is not after the last one of an earlier chunk is late: it is written to
    the table late and counts for nothing. A chunk that comes again under its
    number replaces what it left.
    """

    def __init__(self, spark: SparkSession, path: str, size: int, width: int = 1) -> None:
        self.spark, self.path, self.size, self.width = spark, path.rstrip("/"), size, width

    def _table(self, name: str, schema: str) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")

    def tail(self, before: int | None = None) -> DataFrame:
        """The last width rows (ord, features) of the chunks, or of those before a number."""
        rows = self._table("tail", "ord long, features array<double>")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        last = rows.agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == (-1 if last is None else last)).select("ord", "features")

    def add(self, chunk: DataFrame, number: int) -> None:
        """chunk: (ord, features)."""
        kept = self.spark.createDataFrame(self.tail(number).collect(), "ord long, features array<double>")  # width rows
        last = kept.agg(F.max("ord")).first()[0]
        rows = chunk.select(F.col("ord").cast("long").alias("ord"), "features")
        new = rows if last is None else rows.where(F.col("ord") > last)
        late = rows.where("false") if last is None else rows.where(~(F.col("ord") > last) | F.col("ord").isNull())
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        write(late, "late")
        plus = pair_states(kept.unionByName(new), self.size, self.width).withColumn("sign", F.lit(1.0))
        minus = pair_states(kept, self.size, self.width).withColumn("sign", F.lit(-1.0))
        write(plus.union(minus), "states")
        write(new.orderBy("ord").limit(self.width), "head")
        write(kept.unionByName(new).orderBy(F.desc("ord")).limit(self.width), "tail")

    def moments(self, mode: str = "regular") -> Moments:
        """Of all chunks so far: regular, or window (pairs up to width apart; node weights fall to a half at both ends, as in moments.window)."""
        states = self._table("states", "state array<double>, sign double").select("state", "sign")

        def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for state, sign in zip(batch.column("state"), batch.column("sign").to_pylist(), strict=True):
                    values = pa.array(state.values.to_numpy(zero_copy_only=False) * sign)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], ["state"])

        total = merge(states.mapInArrow(signed, "state array<double>"), self.size)
        if mode == "regular":
            return total
        if mode != "window":
            raise ValueError(f"no mode of chunks is called {mode}")
        rows = round(total.q)
        if 2 * self.width >= rows:
            raise ValueError(f"a window of {self.width} needs more than {rows} samples")
        first = self._table("head", "ord long, features array<double>").orderBy("ord").limit(self.width).toArrow()
        final = self.tail().orderBy(F.desc("ord")).toArrow()
        for ends in (first, final):
            x = matrix(ends.combine_chunks()) if ends.num_rows else np.zeros((0, self.size))
            lost = 1 - (np.arange(len(x)) + self.width) / (2 * self.width)
            total.nodes(x, -lost)
        total.q += 1.0  # the sum of node weights is counted as rows - (width - 1) / 2
        return total

    def late(self) -> DataFrame:
        """(ord, features, batch) of the rows that came late."""
        return self._table("late", "ord long, features array<double>")

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Starts folding a stream of (ord, features), a batch a chunk."""
        return stream.writeStream.foreachBatch(lambda rows, number: self.add(rows, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
