"""Query registry: name -> (spark, sf_dir) -> DataFrame, plus the DuckDB oracle SQL.

Each registered query reads the driver tables (or what Spark derives from them)
over their whole extent; the oracle SQL computes the same result independently.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

_MODULES = (
    "quarry.plans.saturation_queries",
    "quarry.plans.log_queries",
    "quarry.plans.faq_queries",
    "quarry.plans.text_queries",
    "quarry.plans.vector_queries",
    "quarry.plans.cluster_queries",
    "quarry.plans.misc_queries",
    "quarry.plans.experiments",
)


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
