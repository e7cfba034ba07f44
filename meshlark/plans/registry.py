"""All registered queries and their SQL checks, gathered from the family modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ["asset_queries", "ledger_queries", "mesh_queries", "point_queries", "trajectory_queries"]


def _modules():
    return [importlib.import_module(f"meshlark.plans.{name}") for name in FAMILIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
