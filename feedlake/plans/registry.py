"""Registry of named queries over the driver tables, each with optional oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame``. The oracle is an
equivalent SQL text over the same tables (as views) for an independent engine;
column names must match the DataFrame's.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn
    return deco
