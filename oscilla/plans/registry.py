"""Registry of named queries and, where SQL can express them, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from oscilla.session import ship_package

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")

        @wraps(plan)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return plan(spark, sf_dir)

        PLANS[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register
