"""All queries of the library's own operators and their DuckDB counterparts."""

from __future__ import annotations

import importlib

MODULES = ("operators.kpi", "operators.profile", "operators.clean", "operators.series", "operators.points", "operators.leads", "operators.outliers", "operators.pipelines", "operators.forecast", "operators.factor", "operators.cluster", "operators.scorers", "sources.files")
_books = [importlib.import_module(f"dealscope.{m}").book for m in MODULES]


def queries() -> dict:
    return {k: q for b in _books for k, q in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for b in _books for k, q in b.oracle.items()}
