"""Registered queries over the driver's tables, each with its SQL counterpart.

Doubles are rounded alike on both sides, as sums run in another order there.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("data", "windows", "trading", "full", "checks")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in import_module(f"quantloom.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in import_module(f"quantloom.plans.{m}").ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_sma_metrics"](spark, sf_dir)
