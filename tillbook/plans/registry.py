"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

MODULES = ["store", "directory", "quality", "sources"]


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(import_module(f"tillbook.plans.{name}").QUERIES)
    return found


def oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found.update(import_module(f"tillbook.plans.{name}").ORACLES)
    return found
