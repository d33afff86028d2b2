"""Queries and SQL of the corpus operators."""

from __future__ import annotations

import importlib

MODULES = ("secrets", "bpe", "urls", "quality", "near_dedup", "substring", "decontaminate", "toxicity", "pii", "html_text", "packing", "alignment", "spelling")


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= importlib.import_module(f"panelmill.llm.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"panelmill.llm.{name}"), "ORACLE_SQL", {})
    return out
