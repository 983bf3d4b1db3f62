"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

_MODULES = ["toxicity", "secrets", "urls", "quality", "simhash", "pii", "packing", "html_text", "substrings", "decontaminate"]


def _modules():
    return [importlib.import_module(f"helixframe.llm.{name}") for name in _MODULES]


def queries() -> dict:
    """Query functions by name."""
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name; only where SQL can express the query."""
    return {m.NAME: m.ORACLE_SQL for m in _modules() if m.ORACLE_SQL}
