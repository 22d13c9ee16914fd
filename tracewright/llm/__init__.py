"""Operators for preparing training text at scale. Nothing else in the library imports this subpackage."""

from __future__ import annotations


def queries() -> dict:
    """The queries of this subpackage by name."""
    from tracewright.llm import registry

    return registry.queries()


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those queries that SQL can express."""
    from tracewright.llm import registry

    return registry.oracle_sql()
