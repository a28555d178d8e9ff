"""Named queries over the test tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAMILIES: list[str] = ["records", "search", "browse", "passages", "pipeline", "documents", "layout", "requests", "curation"]


def _families() -> list:
    return [importlib.import_module(f"{__name__}.{f}") for f in FAMILIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _families() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _families() for k, s in m.SQL.items()}
