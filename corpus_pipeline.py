"""The corpus pipeline: documents of good quality, without shared lines and near copies, packed into sequences.

Every stage works on all that its predecessor kept, which is written and read
again between them. The functions of the stages say what becomes of null and
empty texts, repeated rows and rows without a doc_id; other columns go through
as they are, whatever their names, and empty tables give no rows. Very long
texts are read, judged, compared and packed whole, each within one task, which
takes some tens of times a text's size in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm.common import read_table, stage
from driftline.llm.jaccard_join import drop_near_duplicates
from driftline.llm.line_dedup import drop_frequent_lines
from driftline.llm.packing import pack_documents
from driftline.llm.quality import keep_good
from driftline.llm.word_tokens import default_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects, each judged by its own text, null and empty ones too."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share lose all copies but the first. A null text comes out empty; no document goes."""
    return drop_frequent_lines(docs, keep_first=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group of near copies; rows without words or a doc_id, and unlike texts under one doc_id, all stay."""
    return drop_near_duplicates(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; a document without text is its end id alone."""
    return pack_documents(docs, default_path())


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", shared_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", packed_sequences),
]

#: The classifier, the tokenizer and the search for a packing have no SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
