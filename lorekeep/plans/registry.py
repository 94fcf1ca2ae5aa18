"""Collects the named queries of the core; each module of this folder offers QUERIES and ORACLE."""

from __future__ import annotations

import importlib

MODULES = ("timestamps", "visibility", "statistics", "retrieval", "similarity", "lifecycle", "evaluation", "texts", "streams")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(importlib.import_module(f"lorekeep.plans.{name}"), attribute))
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
