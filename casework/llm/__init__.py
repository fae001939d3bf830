"""Operators for preparing training data at scale; nothing else in the library imports this package."""

from importlib import import_module

_MODULES = ("leakage", "chunking", "mixing", "keyword_spam", "near_dup", "neighbours", "name_variants", "email_text", "personal_data", "scan_noise")


def _gather(attr: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(import_module(f"casework.llm.{m}"), attr)
    return dict(sorted(out.items()))


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
