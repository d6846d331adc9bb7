"""The registered queries of the engine and the SQL that they are checked against, by subject."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

SUBJECTS = ("retrieval", "recall", "weights", "releases", "texts", "evidence", "operations", "assembly")
FLAGSHIP = "component_search_items"


def _all(what: str) -> dict:
    return {k: v for s in SUBJECTS for k, v in getattr(import_module(f"{__name__}.{s}"), what).items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
