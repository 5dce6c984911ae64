"""The registered queries of the reference's own operators: name -> (query, oracle SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Modules that hold a ``QUERIES`` table.
MODULES: tuple[str, ...] = ("indicators", "eda", "relational", "texts", "events", "models", "dashboard", "streams", "files", "paging")


def _all() -> dict[str, tuple[Callable, str | None]]:
    found: dict[str, tuple[Callable, str | None]] = {}
    for name in MODULES:
        found |= importlib.import_module(f"tidegauge.plans.{name}").QUERIES
    return found


def queries() -> dict[str, Callable]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
