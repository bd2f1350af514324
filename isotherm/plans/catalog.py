"""Registry of the queries: one Spark callable and, where SQL can say it, one oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isotherm.plans.oracle import oracle
from isotherm.plans.workload import Workload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(workload)`` under ``name``."""

    def register(build: Callable[[Workload], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Workload(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return build

    return register
