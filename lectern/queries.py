"""Every query of the core, with the SQL it is compared with."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lectern import plans
from lectern.registry import ORACLES, PLANS, Plan, Tables

for _module in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"lectern.plans.{_module.name}")


def _run(plan: Plan, spark: SparkSession, folder: str) -> DataFrame:
    return plan(Tables(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, plan) for name, plan in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
