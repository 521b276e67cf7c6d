"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import digest, heap_codes, jaccard_join, katz, line_dedup, lloyd, media_chunks, packing, piece_tokens, quality, token_files, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": jaccard_join.op1,
    "op2_katz": katz.op2,
    "op3_feature_digest": digest.op3,
    "op4_piece_tokens": piece_tokens.op4,
    "op5_quadratic_discriminant": quality.op5,
    "op6_bin_completion": packing.op6,
    "op7_link_graph": url_filter.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_media_chunks": media_chunks.op9,
    "op10_token_files": token_files.op10,
    "op11_channel_toxicity": toxicity.op11,
    "op12_lloyd": lloyd.op12,
    "op13_heap_codes": heap_codes.op13,
}

ORACLES: dict[str, str] = {
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op12_lloyd": lloyd.OP12_SQL,
    "op13_heap_codes": heap_codes.OP13_SQL,
}
