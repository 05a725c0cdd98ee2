"""The registered queries: one per operator, over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_FAMILIES = ("aggregation", "selection", "windows", "finance", "compliance", "files", "cleaning", "profiling", "joins",
             "tests", "charts", "anomalies", "insights")



def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with the DuckDB query it must equal."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    for family in _FAMILIES:
        import_module(f"tabulith.catalog.{family}")
