"""Queries of the llm operators for the driver."""

from __future__ import annotations

from . import chat_format, exact_dedup, merge_replay, packing, pii, quality, secrets_scan, separator_scan, simhash, token_files


def queries() -> dict:
    own = [
        pii.op1_pii, token_files.op2_token_files, exact_dedup.op3_exact_dedup, separator_scan.op4_token_counts, simhash.op5_simhash,
        chat_format.op6_chat_format, secrets_scan.op7_secrets, merge_replay.op8_merge_replay, packing.op9_mixture_packing, quality.op10_quality_rules,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.OP3_SQL, "op6_chat_format": chat_format.OP6_SQL}
