"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from corpusloom.llm import chat, editprint, lm, mixing, packing, pii, rules, simhash, substrings, toxicity

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_edit_fingerprints": editprint.query,
    "op3_pii": pii.query,
    "op4_brown_lm": lm.query,
    "op5_packing": packing.query,
    "op6_chat": chat.query,
    "op7_mixing": mixing.query,
    "op8_quality_rules": rules.query,
    "op9_substrings": substrings.query,
    "op10_toxicity": toxicity.query,
}

SQL: dict[str, str] = {"op6_chat": chat.SQL, "op9_substrings": substrings.SQL}
