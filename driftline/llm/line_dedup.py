"""Operator 8: lines that many documents share (DataFrame functions only).

Only hashes of lines move. They are partitioned by range of (hash, document),
so that a line of a third of all documents is spread over many ranges, and
sorted within by document and position. A window over that order streams each
document's first line of a run of equal hashes, and the sorted table is
written with the number of its range. A row for each hash and range then counts
the documents; the ranges' counts are added up to tell the frequent hashes, and
bits are set by (hash, range), so that a frequent line is never gathered. The
result is a bitmap for each document, of which only the 64-line words with a
dropped line are stored. The text is joined to its bitmap at the end only, by
``apply_bitmaps``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import lower_ascii, parts, read_table, stage

#: What is stripped from both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"


def _row_key() -> Column:
    """With doc_id, names a row; rows that repeat doc_id and text are one document."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame) -> DataFrame:
    """(h, g, row_key, doc_id, pos) of all lines with a key: 96 bits of hash for each."""
    keys = F.transform(_split(lower_ascii(F.coalesce("text", F.lit("")))), lambda x: F.btrim(x, F.lit(STRIPPED)))
    hashes = F.transform(keys, lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("h"), F.hash(k).alias("g"))))
    rows = docs.select(_row_key().alias("row_key"), "doc_id", F.posexplode(hashes).alias("pos", "key"))
    return rows.where("key is not null").select("key.h", "key.g", "row_key", "doc_id", "pos")


def sorted_lines(lines: DataFrame) -> DataFrame:
    """lines with their range part and new: whether the line is its document's first of its hash. In order of (h, g, row_key, doc_id, pos) within a range."""
    by = ["h", "g", "row_key", "doc_id"]
    ranged = lines.repartitionByRange(2 * parts(lines), *by).sortWithinPartitions(*by, "pos")
    first = F.row_number().over(W.partitionBy(*by).orderBy("pos")) == 1
    return ranged.withColumn("new", first).withColumn("part", F.spark_partition_id())


def frequent_lines(ranged: DataFrame, least_docs: int) -> DataFrame:
    """(h, g, part, first) of the ranges that hold lines in least_docs documents at least; first: (doc_id, row_key, pos) of the first occurrence in all ranges."""
    held = ranged.where("new").groupBy("h", "g", "part").agg(F.count("*").alias("documents"), F.min(F.struct("doc_id", "row_key", "pos")).alias("first"))
    total = held.groupBy("h", "g").agg(F.sum("documents").alias("documents"), F.min("first").alias("first"), F.collect_list("part").alias("parts")).where(F.col("documents") >= least_docs)
    return total.select("h", "g", F.explode("parts").alias("part"), "first")


def keep_bitmaps(docs: DataFrame, least_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(row_key, doc_id, dropped ARRAY<STRUCT<word INT, bits BIGINT>>) of the documents that lose lines.

    Bit b of word w is set if line 64 * w + b goes; words without a set bit
    are left out, and so are documents that keep every line. With keep_first
    the first occurrence of each frequent line, by doc_id and position, stays.
    """
    ranged = stage(sorted_lines(line_hashes(docs)), "lines")
    often = frequent_lines(ranged, least_docs).withColumnsRenamed({"h": "fh", "g": "fg", "part": "fpart"})
    found = ranged.join(often, (F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg")) & (F.col("part") == F.col("fpart")))
    if keep_first:
        found = found.where(~((F.col("row_key") == F.col("first.row_key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = found.groupBy("row_key", "doc_id", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("row_key", "doc_id").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text, the struct _rest of docs' other columns (if any), _lines (all lines) and _kept (those the bitmap keeps)."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.select("doc_id", "text", *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("_rest")] if others else []))
    held = bitmaps.select(F.col("row_key").alias("_key"), F.col("doc_id").alias("_of"), "dropped")
    rows = docs.withColumn("_row", _row_key()).join(held, (F.col("_row") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_of")), "left")
    rows = rows.withColumn("_map", F.map_from_entries("dropped")).withColumn("_last", F.element_at("dropped", -1)["word"])
    dense = F.when(F.col("dropped").isNotNull(), F.transform(F.sequence(F.lit(0), "_last"), lambda w: F.coalesce(F.try_element_at("_map", w), F.lit(0).cast("long"))))
    rows = rows.withColumn("_dense", dense).withColumn("_lines", _split(F.coalesce("text", F.lit(""))))
    gone = lambda i: F.coalesce(F.getbit(F.get("_dense", F.floor(i / 64).cast("int")), i % 64), F.lit(0)) == 1
    kept = F.when(F.col("_dense").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x, i: ~gone(i)))
    return rows.withColumn("_kept", kept).drop("_row", "_key", "_of", "dropped", "_map", "_last", "_dense")


def drop_frequent_lines(docs: DataFrame, least_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """docs with their text less the frequent lines, and n_chars (where docs has it) counted anew.

    A line's key is the line stripped of 0x20 and 0x09-0x0D at both ends, A-Z
    lower-cased; lines with an empty key stay. Null and empty texts have one
    empty line and come out empty. Rows that repeat doc_id and text count as
    one document and are all kept; rows of one doc_id with other texts are
    documents of their own. All rows of docs stay, and its columns and types.
    """
    out = apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), least_docs, keep_first)).withColumn("text", F.array_join("_kept", "\n"))
    value = {c: F.col(c) if c in ("doc_id", "text") else F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"_rest.`{c}`") for c in docs.columns}
    return out.select(*[v.alias(c) for c, v in value.items()])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"), F.sha2(F.array_join("_kept", "\n"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""
