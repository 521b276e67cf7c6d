"""Operator 10: token ids in binary shards, zstandard with a shared dictionary.

A shard holds a range of documents in ascending doc_id order. Each document's
ids are one zstandard frame of their own, so a short document is read
without its neighbours; a dictionary trained on serialised id arrays makes
short frames small. A shard's layout, integers little-endian:

=========  ==========================================================
header     8 bytes magic, 32 bytes SHA-256 of the dictionary, 1 byte
           width of an id (2 or 4)
frames     one zstandard frame a document
index      documents: doc_id int64, 1 byte null mark, ids int64,
           offset uint64 of the frame; arrays one after another
footer     end of the last frame uint64, documents uint64, magic
=========  ==========================================================

The dictionary lies beside the shards under its hash; a reader that is given
another one fails. Shards are written to a name of the attempt and moved when
complete, so a task that is run again leaves the same files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import giving_back, parts, read_table, slices, small_batches, stage_path
from driftline.llm.word_tokens import BATCH_BYTES, default_path, word_tokens

MAGIC = b"DLTOKEN1"
#: Documents the dictionary is trained on: those of the smallest hashes of doc_id and text.
SAMPLE_DOCS = 512
#: Bytes of text in a shard, about; where the shuffle has more partitions, there are as many shards. Bytes of ids that a reader holds at a time.
SHARD_BYTES, READ_BYTES = 256 << 20, 4 << 20
SAMPLE_PIECE = 16384
DICTIONARY_BYTES = 112_640
LEVEL = 3
END_ID = 2


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; too few samples give a plain one of their bytes."""
    pieces = [s[k : k + SAMPLE_PIECE] for s in samples for k in range(0, len(s), SAMPLE_PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class ShardWriter:
    def __init__(self, out, dictionary: bytes, width: int) -> None:
        self.out, self.width = out, width
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.offsets: list[int] = []
        self.place = out.write(MAGIC + hashlib.sha256(dictionary).digest() + bytes([width]))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.offsets.append(self.place)
        self.place += self.out.write(self.zip.compress(ids.astype(f"<u{self.width}").tobytes()))

    def close(self) -> None:
        ids = np.array([x or 0 for x in self.docs], "<i8")
        null = np.array([x is None for x in self.docs], np.uint8)
        for part in (ids, null, np.array(self.sizes, "<i8"), np.array(self.offsets, "<u8"), np.array([self.place, len(ids)], "<u8")):
            self.out.write(part.tobytes())
        self.out.write(MAGIC)
        self.out.close()


class ShardReader:
    """Any document of a shard by its place, without the others."""

    def __init__(self, uri: str, dictionary: bytes) -> None:
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        head = self.file.read_at(41, 0)
        size = self.file.size()
        foot = self.file.read_at(24, size - 24)
        if head[:8] != MAGIC or foot[16:] != MAGIC:
            raise ValueError(f"{uri} is not a complete token shard")
        if head[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.width = head[40]
        self.end, n = (int(x) for x in np.frombuffer(foot[:16], "<u8"))
        index = self.file.read_at(25 * n, self.end)
        self.ids = np.frombuffer(index, "<i8", n)
        self.null = np.frombuffer(index, np.uint8, n, 8 * n) > 0
        self.sizes = np.frombuffer(index, "<i8", n, 9 * n)
        self.offsets = np.append(np.frombuffer(index, "<u8", n, 17 * n), np.uint64(self.end)).astype(np.int64)
        self.unzip = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def read(self, k: int) -> np.ndarray:
        blob = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
        return np.frombuffer(self.unzip.decompress(blob), f"<u{self.width}")

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document by its doc_id, or None; the index is in ascending order after its nulls."""
        first = int(self.null.sum())
        k = first + int(np.searchsorted(self.ids[first:], doc_id))
        return self.read(k) if k < len(self.ids) and self.ids[k] == doc_id else None


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> tuple[list[dict], bytes]:
    """Writes the shards of docs (doc_id, text) to folder; the manifest, in doc_id order, and the dictionary.

    Null texts are empty; null doc_ids come first; rows that repeat a doc_id
    are all written, in the order of a hash of their texts. No rows: no
    shards. The manifest has a row for each shard: path, documents, tokens,
    and start, the tokens of all shards before it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("_k", F.xxhash64("doc_id", "text"))
    chosen = [r[0] for r in docs.where("doc_id is not null").select("_k").orderBy("_k").limit(SAMPLE_DOCS).collect()]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_path)
        for batch in batches:
            for piece in slices(batch, limit=BATCH_BYTES):
                ids, at = tokens.encode(piece.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array([np.append(ids[a:b], end_id).astype("<u2" if len(tokens.ends) <= 1 << 16 else "<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["ids"])

    rows = docs.where(F.col("_k").isin(chosen)).dropDuplicates(["_k"]).select("doc_id", "text").mapInArrow(giving_back(sample), "ids binary").collect() if chosen else []
    dictionary = train_dictionary(sorted(bytes(r[0]) for r in rows))
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{hashlib.sha256(dictionary).hexdigest()}.zdict") as f:
        f.write(dictionary)
    held = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_path)
        shard = TaskContext.get().partitionId()
        fs, path = _open(folder)
        name, draft = f"{path}/shard-{shard:06d}.tok", f"{path}/draft-{shard:06d}-{uuid.uuid4().hex}"
        writer, total = None, 0
        for batch in batches:
            for piece in slices(batch, limit=BATCH_BYTES):
                writer = writer or ShardWriter(fs.open_output_stream(draft), held.value, 2 if len(tokens.ends) <= 1 << 16 else 4)
                ids, at = tokens.encode(piece.column("text"))
                for doc_id, a, b in zip(piece.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    writer.add(doc_id, np.append(ids[a:b], end_id))
                total += len(ids) + len(at) - 1
        if writer:
            writer.close()
            fs.move(draft, name)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "documents": pa.array([len(writer.docs)]), "tokens": pa.array([total])})

    ordered = docs.drop("_k").repartitionByRange(max(parts(docs), size // SHARD_BYTES), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    done = ordered.mapInArrow(giving_back(write), "shard int, documents long, tokens long").collect()
    manifest, start = [], 0
    for r in sorted(done):
        manifest.append({"shard": r["shard"], "path": f"{folder}/shard-{r['shard']:06d}.tok", "documents": r["documents"], "tokens": r["tokens"], "start": start})
        start += r["tokens"]
    return manifest, dictionary


def read_token_files(spark: SparkSession, manifest: list[dict], dictionary: bytes) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, frame_bytes) of every document, from the files; a shard is one task."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long"
    if not manifest:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(dictionary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = ShardReader(path, held.value)
                starts = start + np.concatenate([[0], np.cumsum(shard.sizes)])
                rooms = np.searchsorted(np.cumsum(shard.sizes * shard.width) // READ_BYTES, np.arange(shard.sizes.sum() * shard.width // READ_BYTES + 2))
                for k, end in zip(rooms[:-1].tolist(), rooms[1:].tolist(), strict=True):
                    ids = [shard.read(i) for i in range(k, end)]
                    here = slice(k, k + len(ids))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.ids[here], mask=shard.null[here]), pa.array(starts[here]), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(np.diff(shard.offsets)[here])],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "frame_bytes"],
                    )

    rows = spark.createDataFrame([(m["shard"], m["path"], m["start"]) for m in manifest], "shard int, path string, start long")
    return rows.repartitionByRange(len(manifest), "shard").mapInArrow(giving_back(read), schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, dictionary = write_token_files(read_table(spark, sf_dir, "documents"), default_path(), stage_path(spark, "tokens"))
    return read_token_files(spark, manifest, dictionary)
