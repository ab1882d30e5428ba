"""The queries of this subpackage, one for each operator, and the SQL for those that SQL can express."""

from __future__ import annotations

from lociflow.llm import chat, decontamination, html_text, jaccard, line_dedup, line_quality, mixing, pii, prefix_trie, quality, secrets, sharding, variants

QUERIES = {
    "op1_randomness_secrets": secrets.query,
    "op2_bilstm_crf_pii": pii.query,
    "op3_hash_threshold_mixing": mixing.query,
    "op4_budgeted_chat_windows": chat.query,
    "op5_heavy_light_jaccard": jaccard.query,
    "op6_crf_line_quality": line_quality.query,
    "op7_gbdt_html_text": html_text.query,
    "op8_winnowing_decontamination": decontamination.query,
    "op9_virtual_slot_sharding": sharding.query,
    "op10_ordinal_quality": quality.query,
    "op11_spelling_neighbourhoods": variants.query,
    "op12_line_dedup": line_dedup.query,
    "op13_conversation_trie": prefix_trie.query,
}
SQL: dict[str, str] = {
    "op3_hash_threshold_mixing": mixing.SQL,
    "op4_budgeted_chat_windows": chat.SQL,
    "op5_heavy_light_jaccard": jaccard.SQL,
    "op7_gbdt_html_text": html_text.SQL,
    "op8_winnowing_decontamination": decontamination.SQL,
    "op9_virtual_slot_sharding": sharding.SQL,
    "op11_spelling_neighbourhoods": variants.SQL,
    "op12_line_dedup": line_dedup.SQL,
    "op13_conversation_trie": prefix_trie.SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
