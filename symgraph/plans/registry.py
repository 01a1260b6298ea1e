"""All queries of the core library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symgraph.plans import data_problems, fixture_queries, graph_queries, pipeline_queries, report_queries

MODULES = [data_problems, graph_queries, pipeline_queries, report_queries, fixture_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_problems.p2_target_stats(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
