"""Queries and DuckDB SQL of the llm operators."""

from __future__ import annotations

from cairnflow.llm import bpe, chat, jaccard_join, packing, quality, secret_scan, suffix_dedup, topk, toxicity, warc

_QUERIES = [
    (secret_scan.op1_secret_scan, secret_scan.OP1_SQL),
    (topk.op2_top_k, topk.OP2_SQL),
    (bpe.op3_bpe_codec, None),
    (packing.op4_best_fit_packing, None),
    (quality.op6_compression_bands, None),
    (chat.op9_chat_format, chat.OP9_SQL),
    (toxicity.op5_toxicity, None),
    (jaccard_join.op10_jaccard_join, None),
    (suffix_dedup.op8_suffix_dedup, None),
    (warc.op7_warc_derivatives, None),
]


def queries() -> dict:
    return {f.__name__: f for f, _ in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _QUERIES if sql}
