"""All core queries by name."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("inventory", "findings", "searching", "production", "reviewing", "packing")


def _gather(attr: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(import_module(f"casework.plans.{m}"), attr)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
