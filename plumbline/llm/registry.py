"""The queries of the ten operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from plumbline.llm import chat, decontam, langid, licenses, mixing, near_dup, neighbours, pii, tokens, toxicity

QUERIES = {
    "op1_nearest_neighbours": neighbours.query,
    "op2_language": langid.query,
    "op3_personal_data": pii.query,
    "op4_near_duplicates": near_dup.query,
    "op5_chat_formatting": chat.query,
    "op6_mixing": mixing.query,
    "op7_decontamination": decontam.query,
    "op8_licenses": licenses.query,
    "op9_toxicity": toxicity.query,
    "op10_token_counts": tokens.query,
}
ORACLES = {
    "op1_nearest_neighbours": neighbours.ORACLE,
    "op4_near_duplicates": near_dup.ORACLE,
    "op5_chat_formatting": chat.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op7_decontamination": decontam.ORACLE,
    "op8_licenses": licenses.ORACLE,
}
