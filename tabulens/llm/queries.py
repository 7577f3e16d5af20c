"""The registered queries of the operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from tabulens.llm import align, bpe, chat, dedup, html, licenses, lm, mixing, pieces, quality, syncmers, tokens, whitening

QUERIES = {
    "op1_near_duplicates": dedup.op1_near_duplicates,
    "op2_fingerprints": syncmers.op2_fingerprints,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_main_text": html.op5_main_text,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_sampled_pieces": pieces.op8_sampled_pieces,
    "op9_chat_format": chat.op9_chat_format,
    "op10_lm_scores": lm.op10_lm_scores,
    "op11_bpe_roundtrip": bpe.op11_bpe_roundtrip,
    "op12_token_alignment": align.op12_token_alignment,
    "op13_whitened_vectors": whitening.op13_whitened_vectors,
}
ORACLE = {
    "op1_near_duplicates": dedup.OP1_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op7_license_scan": licenses.OP7_SQL,
    "op9_chat_format": chat.OP9_SQL,
}
