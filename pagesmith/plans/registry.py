"""All core queries by name, with the SQL that states the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ["text", "layout", "markup", "work", "files", "small", "more"]


def _modules():
    return [importlib.import_module(f"pagesmith.plans.{m}") for m in MODULES]


def queries() -> dict[str, Query]:
    return {k: v for m in _modules() for k, v in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.S.items()}
