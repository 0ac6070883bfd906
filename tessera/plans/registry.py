"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import q_functions, q_index, q_search, q_stats

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (q_functions, q_search, q_index, q_stats)


def queries() -> dict[str, Query]:
    return {name: fn for m in _MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_search.top_documents(spark, sf_dir)
