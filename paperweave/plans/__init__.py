"""Logical tables, composed jobs and registered queries."""

from importlib import import_module

QUERY_MODULES = ("report_queries", "graph_queries", "catalog_queries", "resolve_queries", "semantic_queries", "source_queries", "load_queries")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in QUERY_MODULES:
        import_module(f"{__name__}.{name}")
