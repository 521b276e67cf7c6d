"""Operator 9: media payloads as content-defined chunks that are stored once.

A rolling gear hash cuts each payload where its own bytes say so; equal
passages give equal chunks wherever they stand. Tasks write the chunks that
are new to them to packs; Spark joins the digests of all packs, one home is
kept for each digest, and the packs are rewritten with the chunks that live
there. A document is its ordered chunk list (the recipe). Reading fetches
the chunks, verifies their digests and gives the payload.

A pack is chunks (a zstandard frame each), then an index (digests, offsets,
sizes) and a footer. Packs appear under their name only when complete, and a
rewritten pack is recognised by a task that runs again, so lost executors
leave nothing half done.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import giving_back, parts, read_table, slices, small_batches, stage, stage_path, text_buffer
from driftline.llm.hashing import mix

#: Payload bytes a text is padded to, and the byte that pads.
UNIT, PAD = 576, 255
#: Chunk sizes: none below, a cut with odds 1 / 2**CUT_BITS after, none above.
LEAST, CUT_BITS, MOST = 512, 11, 16384
MAGIC = b"DLPACK01"
LEVEL = 3
_GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(0x6A09E667)) >> np.uint64(32)).astype(np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """The gear hash ``h = (h << 1) + value[byte]`` modulo 2**32 after each byte; it holds the last 32 bytes."""
    h = _GEAR[buf]
    step = 1
    while step < 32:
        h[step:] += h[:-step] << np.uint32(step)  # the right side is computed before it is added
        step *= 2
    return h


def cuts(buf: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each payload, from its start."""
    marks = np.flatnonzero(gear(buf) >> np.uint32(32 - CUT_BITS) == 0) + 1
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        mine = marks[np.searchsorted(marks, a) : np.searchsorted(marks, b, "right")].tolist()
        ends, at = [], a
        while b - at > LEAST:
            k = bisect_left(mine, at + LEAST)
            cut = min(mine[k] if k < len(mine) else b, at + MOST, b)
            ends.append(cut - a)
            at = cut
        if at < b:
            ends.append(b - a)
        out.append(ends)
    return out


def pad_text(text: bytes) -> bytes:
    return text + bytes([PAD]) * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


class PackWriter:
    def __init__(self, folder: str, name: str) -> None:
        self.fs, path = pafs.FileSystem.from_uri(folder)
        self.name, self.draft = f"{path}/{name}", f"{path}/draft-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft)
        self.index: dict[bytes, tuple[int, int]] = {}
        self.place = 0

    def add(self, digest: bytes, frame: bytes) -> None:
        self.out.write(frame)
        self.index[digest] = self.place, len(frame)
        self.place += len(frame)

    def close(self) -> None:
        self.out.write(b"".join(self.index))
        self.out.write(np.array(list(self.index.values()), "<u8").reshape(-1, 2).tobytes())
        self.out.write(np.array([self.place, len(self.index)], "<u8").tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.draft, self.name)


class Pack:
    def __init__(self, folder: str, name: str) -> None:
        fs, path = pafs.FileSystem.from_uri(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        foot = self.file.read_at(24, size - 24)
        if foot[16:] != MAGIC:
            raise ValueError(f"{name} is not a complete pack")
        self.end, n = (int(x) for x in np.frombuffer(foot[:16], "<u8"))
        index = self.file.read_at(48 * n, self.end)
        self.digests = [index[k : k + 32] for k in range(0, 32 * n, 32)]
        self.places = np.frombuffer(index, "<u8", 2 * n, 32 * n).reshape(-1, 2).astype(np.int64)

    def frame(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)


def ingest(docs: DataFrame, folder: str) -> DataFrame:
    """Writes packs; (doc_id, row_id, n_bytes, seq, digest, length, pack) for every chunk of every payload.

    row_id names the row, so repeated rows and doc_ids stay apart.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        writer, row_id = None, part << 36
        name = f"pack-{part:06d}-{uuid.uuid4().hex}"
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for piece in slices(batch):
                writer = writer or PackWriter(folder, name)
                buf, off = text_buffer(piece.column("text"))
                payloads = [pad_text(buf[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in payloads])])
                row, seq, digest, length = [], [], [], []
                for d, (payload, stops) in enumerate(zip(payloads, cuts(np.frombuffer(b"".join(payloads), np.uint8), ends), strict=True)):
                    for k, (a, b) in enumerate(zip([0, *stops], stops, strict=False)):
                        chunk = payload[a:b]
                        name_of = hashlib.sha256(chunk).digest()
                        if name_of not in writer.index:
                            writer.add(name_of, pack.compress(chunk))
                        row.append(d)
                        seq.append(k)
                        digest.append(name_of)
                        length.append(b - a)
                at = pa.array(row, pa.int64())
                ids = pa.array(np.arange(row_id, row_id + len(payloads)))
                row_id += len(payloads)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(at), ids.take(at), pa.array(np.diff(off)).take(at), pa.array(seq, pa.int32()), pa.array(digest, pa.binary()), pa.array(length, pa.int32()), pa.array([name] * len(row), pa.string())],
                    ["doc_id", "row_id", "n_bytes", "seq", "digest", "length", "pack"],
                )
        if writer:
            writer.close()

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {kind}, row_id long, n_bytes long, seq int, digest binary, length int, pack string")


def compact(refs: DataFrame, folder: str) -> DataFrame:
    """Rewrites the packs with the chunks they are home to; (digest, pack, offset, size): each digest's home."""
    homes = refs.groupBy("digest").agg(F.min("pack").alias("pack"))
    packs = refs.select("pack").distinct()
    mine = homes.groupBy("pack").agg(F.collect_list("digest").alias("digests"))  # no more than one task wrote
    mine = packs.join(mine, "pack", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for old, digests in zip(batch.column("pack").to_pylist(), batch.column("digests").to_pylist(), strict=True):
                name = f"home-{old}"
                if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
                    source, keep = Pack(folder, old), set(digests or [])
                    writer = PackWriter(folder, name)
                    for digest, (offset, size) in zip(source.digests, source.places.tolist(), strict=True):
                        if digest in keep:
                            writer.add(digest, source.frame(offset, size))
                    source.file.close()
                    writer.close()
                if fs.get_file_info(f"{path}/{old}").type != pafs.FileType.NotFound:
                    fs.delete_file(f"{path}/{old}")
                made = Pack(folder, name)
                yield pa.RecordBatch.from_arrays([pa.array(made.digests, pa.binary()), pa.array([name] * len(made.digests), pa.string()), pa.array(made.places[:, 0]), pa.array(made.places[:, 1])], ["digest", "pack", "offset", "size"])

    return mine.repartition("pack").mapInArrow(giving_back(run), "digest binary, pack string, offset long, size long")


def store_media(docs: DataFrame, folder: str) -> DataFrame:
    """The recipes: (doc_id, row_id, n_bytes, chunks ARRAY<STRUCT<seq, digest, length, pack, offset, size>>) of every row of docs.

    The payload is the text's UTF-8 (null: empty) and bytes 255 up to a
    positive multiple of UNIT. Rows with a null doc_id, repeated rows and
    repeated doc_ids have a recipe each. An empty table: no recipes.
    """
    small_batches(docs.sparkSession)
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    refs = stage(ingest(docs, folder), "refs")
    homes = stage(compact(refs, folder), "homes").withColumnsRenamed({"digest": "_digest", "pack": "home"})
    found = refs.join(homes, F.col("digest") == F.col("_digest"))
    chunk = F.struct("seq", "digest", "length", F.col("home").alias("pack"), "offset", "size")
    return stage(found.groupBy("row_id").agg(F.min("doc_id").alias("doc_id"), F.min("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(chunk)).alias("chunks")), "recipes")


def features(payload: bytes, chunks: int) -> str:
    """Mean, deviation and entropy of the samples, shares of their sixteen ranges in hexadecimal, and the number of chunks."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts / counts.sum()
    mean = float((share * np.arange(256)).sum())
    spread = float(np.sqrt((share * (np.arange(256) - mean) ** 2).sum()))
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    ranges = "".join(f"{int(x * 255):02x}" for x in share.reshape(16, 16).sum(axis=1))
    return f"{mean:.4f}:{spread:.4f}:{entropy:.4f}:{ranges}:{chunks}"


class ChunkReader:
    """Fetches and verifies chunks; keeps the open packs and the last few megabytes of chunks with their frames."""

    def __init__(self, folder: str, kept_bytes: int = 8 << 20) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.kept: OrderedDict[bytes, tuple[bytes, bytes]] = OrderedDict()
        self.size, self.kept_bytes = 0, kept_bytes
        self.unzip = zstandard.ZstdDecompressor()

    def read(self, digest: bytes, pack: str, offset: int, size: int) -> tuple[bytes, bytes]:
        """The chunk, and its frame as it is stored."""
        if digest in self.kept:
            self.kept.move_to_end(digest)
            return self.kept[digest]
        if pack not in self.files:
            if len(self.files) >= 64:
                self.files.popitem(last=False)[1].close()
            self.files[pack] = self.fs.open_input_file(f"{self.path}/{pack}")
        frame = self.files[pack].read_at(size, offset)
        chunk = self.unzip.decompress(frame)
        if hashlib.sha256(chunk).digest() != digest:
            raise ValueError(f"a chunk of {pack} is not what its digest says")
        self.kept[digest] = chunk, frame
        self.size += len(chunk) + len(frame)
        while self.size > self.kept_bytes:
            self.size -= sum(map(len, self.kept.popitem(last=False)[1]))
        return chunk, frame


def read_media(recipes: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every recipe.

    The stored form of a document, of which media_bytes and media_sha256 are
    size and digest, is its chunk list (magic, number, digests and lengths)
    and the frames of its chunks in order, as the packs hold them.
    """
    kind = recipes.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ChunkReader(folder)
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            for doc_id, n_bytes, chunks in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
                read = [reader.read(c["digest"], c["pack"], c["offset"], c["size"]) for c in chunks]
                payload, frames = (b"".join([x[k] for x in read]) for k in (0, 1))
                listed = b"DLCHUNK1" + len(chunks).to_bytes(4, "little") + b"".join([c["digest"] + c["length"].to_bytes(4, "little") for c in chunks])
                media = hashlib.sha256(listed)
                media.update(frames)
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(listed) + len(frames), media.hexdigest(), features(payload, len(chunks))))
            if rows:
                types = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    # By the place of the first chunk: a task reads its packs from front to back.
    placed = recipes.withColumn("_pack", F.get("chunks", 0)["pack"]).withColumn("_offset", F.get("chunks", 0)["offset"])
    placed = placed.repartitionByRange(parts(recipes), "_pack", "_offset", "row_id").sortWithinPartitions("_pack", "_offset")
    return placed.select("doc_id", "n_bytes", "chunks").mapInArrow(giving_back(run), schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stage_path(spark, "media")
    return read_media(store_media(read_table(spark, sf_dir, "documents"), folder), folder)
