"""All registered queries and their comparison SQL."""

from __future__ import annotations

import importlib

from loomtrace.plans.oracle import build

MODULES = ["metrics_queries", "task_queries", "project_queries", "log_queries", "catalog_queries", "thread_queries", "storage_queries"]


def _modules():
    return [importlib.import_module(f"loomtrace.plans.{name}") for name in MODULES]


def queries() -> dict:
    return {name: fn for module in _modules() for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: build(sql) for module in _modules() for name, sql in module.ORACLES.items()}
