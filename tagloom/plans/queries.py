"""All registered queries of the library, without the subpackage for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answer_queries, catalog_queries, event_queries, record_queries, search_queries

_ALL = catalog_queries.QUERIES | event_queries.QUERIES | record_queries.QUERIES | search_queries.QUERIES | answer_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_queries.budget_slice(spark, sf_dir)
