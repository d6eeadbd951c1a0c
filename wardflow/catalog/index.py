"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("reports", "people", "care", "money_and_stock", "theatre", "checks", "streams")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(getattr(import_module(f"wardflow.catalog.{module}"), attribute))
    return found


def queries() -> dict[str, Query]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("SQL")
