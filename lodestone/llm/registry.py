"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib

_MODULES = {
    "langid": ["op1_language_id"],
    "warc": ["op2_warc"],
    "simhash": ["op3_simhash"],
    "substrings": ["op4_substrings"],
    "packing": ["op5_packing"],
    "quality": ["op6_quality"],
    "mixing": ["op7_mixing"],
    "token_counts": ["op8_token_counts"],
    "toxicity": ["op9_toxicity"],
    "topk": ["op10_topk"],
    "licenses": ["op11_licenses"],
    "dialogue": ["op12_dialogue"],
    "importance": ["op13_importance"],
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"lodestone.llm.{module}"), name) for module, names in _MODULES.items() for name in names}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _MODULES:
        out |= getattr(importlib.import_module(f"lodestone.llm.{module}"), "ORACLE_SQL", {})
    return out
