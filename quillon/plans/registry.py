"""All registered queries of the engine proper, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import catalogue, cluster_views, policies, programs, solved, workload
from quillon.plans.dialect import parse_all
from quillon.plans.evaluate import Evaluation
from quillon.sources import tables


def _by_sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables.register(spark, sf_dir)
        return spark.sql(text)

    return query


def _by_program(name: str) -> Callable[[SparkSession, str], DataFrame]:
    statements, wanted, order, _ = programs.PROGRAMS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables.register(spark, sf_dir)
        found = Evaluation(spark, parse_all(statements), order)
        return (found.violations | found.objectives)[wanted]

    return query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose line items exceed a capacity: one constraint statement, parsed and evaluated."""
    return _by_program("dialect_group_check")(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _by_sql(text) for name, text in catalogue.SPARK.items()} | {name: _by_program(name) for name in programs.PROGRAMS} | {name: cluster_views.query(name) for name in cluster_views.VIEWS | cluster_views.PREEMPTION} | {name: policies.query(name) for name in policies.QUERIES} | {name: f for name, (f, _) in (solved.QUERIES | workload.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.DUCKDB) | {name: p[3] for name, p in programs.PROGRAMS.items()} | {name: cluster_views.sql(name) for name in cluster_views.VIEWS | cluster_views.PREEMPTION} | {name: policies.sql(name) for name in policies.QUERIES} | {name: text for name, (_, text) in (solved.QUERIES | workload.QUERIES).items() if text}
