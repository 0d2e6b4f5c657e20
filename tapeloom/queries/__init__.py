"""All registered queries; importing this package fills the registry."""

from importlib import import_module

from tapeloom.queries.base import ORACLES, QUERIES

MODULES = ("bar_queries", "daily_queries", "book_queries", "desk_queries", "data_queries", "stream_queries", "model_queries")

for _m in MODULES:
    import_module(f"tapeloom.queries.{_m}")

__all__ = ["ORACLES", "QUERIES"]
