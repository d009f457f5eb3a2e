"""Queries and SQL of the training-data operators."""

from vecspark.llm import bm25, bpe, chat, decontaminate, html, licenses, neardup, passages, quality, tokencount


def queries():
    return {
        "op1_quality": quality.op1_quality,
        "op2_minhash_neardup": neardup.op2_minhash_neardup,
        "op3_html_extract": html.op3_html_extract,
        "op4_compact_windows": passages.op4_compact_windows,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_chat_format": chat.op6_chat_format,
        "op7_bpe": bpe.op7_bpe,
        "op8_bm25_topk": bm25.op8_bm25_topk,
        "op9_token_counts": tokencount.op9_token_counts,
        "op10_license_scan": licenses.op10_license_scan,
    }


def oracle_sql():
    return {
        "op2_minhash_neardup": neardup.ORACLE,
        "op5_decontaminate": decontaminate.ORACLE,
        "op6_chat_format": chat.ORACLE,
    }
