"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["expressions", "retention", "analysis", "comparison", "monitoring", "jobs", "streams"]


def _collect(attribute: str) -> dict:
    merged = {}
    for name in MODULES:
        merged.update(getattr(importlib.import_module(f"workload.{name}"), attribute))
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
