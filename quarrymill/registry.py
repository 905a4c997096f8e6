"""All queries of the library by inventory key, each with the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = (
    "quarrymill.plans.lexical_queries",
    "quarrymill.plans.search_queries",
    "quarrymill.plans.table_queries",
    "quarrymill.plans.text_queries",
    "quarrymill.plans.upkeep_queries",
    "quarrymill.plans.extra_queries",
    "quarrymill.plans.state_queries",
    "quarrymill.plans.refined_queries",
    "quarrymill.plans.finer_queries",
    "quarrymill.plans.stored_queries",
    "quarrymill.plans.mechanism_queries",
    "quarrymill.plans.run_queries",
    "quarrymill.plans.derived_queries",
)


def queries() -> dict[str, Callable]:
    found: dict[str, Callable] = {}
    for name in MODULES:
        found |= importlib.import_module(name).QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= importlib.import_module(name).ORACLES
    return found
