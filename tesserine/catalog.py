"""All registered queries with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("operators.text_jobs", "operators.nested", "operators.records", "operators.open_records", "operators.merge", "operators.telemetry", "operators.expand", "operators.cache", "operators.questions", "operators.detect", "operators.lexicons", "operators.search", "operators.text_index", "plans.queries")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"tesserine.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in getattr(import_module(f"tesserine.{m}"), "ORACLES", {}).items()}
