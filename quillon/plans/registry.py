"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame; oracle is DuckDB SQL over the same tables."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


for _module in ("search", "extraction", "security", "structure", "formulas", "joins", "aggregation", "windows", "scalars", "diffs", "ledgers", "sinks_sources", "relational", "events", "extension", "trees", "containers", "plugged"):
    import_module(f"quillon.plans.{_module}")
