"""Registered queries of the graph analytics operators, with their SQL.

A query is a function of Tables; its name starts with the identifier of its operator.
"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans.views import Tables, duck

FLAGSHIP = "g16_graph_health"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of Tables under its own name, with SQL that gives the same rows (in terms of {views})."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = duck(sql)
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    import lodestone.plans as plans

    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.startswith("queries_"):
            importlib.import_module(f"lodestone.plans.{m.name}")
