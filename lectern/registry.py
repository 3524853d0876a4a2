"""The registry of queries: each is a plan over the tables of one folder, with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.session import table

Plan = Callable[["Tables"], DataFrame]


class Tables:
    """Tables of a data folder by name, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; without SQL it is tested by hand in tests."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"two queries named {name}")
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register
