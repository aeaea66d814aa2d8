"""The registered queries of the numbered operators: name -> (query, SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("lang_id", "near_dup", "mixing", "line_dedup", "packing", "toxicity", "html_text", "media", "vector_dup", "pii", "divergence", "vector_codes", "lm")


def all_queries() -> dict:
    return {key: pair for name in MODULES for key, pair in import_module(f"cardflow.llm.{name}").QUERIES.items()}
