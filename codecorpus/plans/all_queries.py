"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES, Query

MODULES = ("measure", "classification", "files", "chunks", "names", "renaming", "calls",
           "caching", "reports", "cleanup", "arrivals")


def _load() -> None:
    for name in MODULES:
        import_module(f"{__package__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
