"""The training-data queries and their SQL, which the entry module adds where this subpackage can be imported."""

from __future__ import annotations

from formloom.llm import audit, bpe, chat, exact, fingerprint, hmm, importance, licence, mixing, near, quality, substring

QUERIES = {
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op2_licence_scan": licence.op2_licence_scan,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_mixing": mixing.op4_mixing,
    "op5_chat_format": chat.op5_chat_format,
    "op6_token_counts": bpe.op6_token_counts,
    "op7_substring_dedup": substring.op7_substring_dedup,
    "op8_exact_dedup": exact.op8_exact_dedup,
    "op9_near_dedup": near.op9_near_dedup,
    "op10_quality": quality.op10_quality,
    "op11_lm_scoring": hmm.op11_lm_scoring,
    "op12_importance": importance.op12_importance,
    "op13_filter_audit": audit.op13_filter_audit,
}
ORACLES = {
    "op4_mixing": mixing.OP4_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op8_exact_dedup": exact.OP8_SQL,
    "op12_importance": importance.OP12_SQL,
    "op13_filter_audit": audit.OP13_SQL,
}
