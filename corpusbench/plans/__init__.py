"""Registered queries over the given tables."""

from importlib import import_module

_MODULES = (
    "text_queries", "matching_queries", "scoring_queries", "contract_queries", "ledger_queries",
    "source_queries", "stream_queries",
)


def load_queries() -> None:
    """Import every query module once, which registers its queries."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
