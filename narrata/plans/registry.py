"""Queries by name: each applies an operator to the model, beside the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from narrata.sources.model import PRELUDE, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of the model; `sql` may begin with further table expressions (", x AS (...) SELECT")."""

    def add(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: f(Model(spark, folder))
        if sql:
            ORACLES[name] = f"{PRELUDE}\n{sql}"
        return f

    return add
