"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
collect what its modules register.
"""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "conversations",
    "decontaminate",
    "language",
    "line_dedup",
    "near_dup",
    "packing",
    "ppm",
    "quality",
    "sharding",
    "spelling",
    "token_files",
    "vector_dup",
    "warc",
)


def queries() -> dict:
    """Query name to callable(spark, sf_dir), of all modules of this subpackage."""
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL where SQL can state the result."""
    return {k: q for m in MODULES for k, q in getattr(import_module(f"{__name__}.{m}"), "ORACLES", {}).items()}
