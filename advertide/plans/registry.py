"""Names of registered queries, the Spark plan of each and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from advertide.plans.inputs import Inputs, oracle_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a plan over the driver tables under an operator's name."""

    def register(plan: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plan(Inputs(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle_text(oracle)
        return plan

    return register
