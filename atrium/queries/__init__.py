"""The registered queries of the engine over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("vectors", "spatial", "ordered", "graphs", "scenes", "evaluation", "mapping", "building")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, (f, _) in import_module(f"{__name__}.{m}").REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in import_module(f"{__name__}.{m}").REGISTRY.items() if sql}
