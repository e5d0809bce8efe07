"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfarer.llm import embedding_dedup, lexical, main_text, mixing, pieces, repeats, sharding, simhash, token_counts, topk, toxicity, vector_codes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_sharding": sharding.op3_sharding,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_warc": warc.op7_warc,
    "op8_pieces": pieces.op8_pieces,
    "op9_top_k": topk.op9_top_k,
    "op10_repeats": repeats.op10_repeats,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_main_text": main_text.op12_main_text,
    "op13_lexical": lexical.op13_lexical,
}

#: DuckDB SQL, where it can express the operator.
ORACLES: dict[str, str] = {
    "op5_embedding_dedup": embedding_dedup.OP5_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_top_k": topk.OP9_SQL,
    "op10_repeats": repeats.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_main_text": main_text.OP12_SQL,
    "op13_lexical": lexical.OP13_SQL,
}
