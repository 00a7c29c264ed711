"""Registered queries of the engine, by operator id, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function under an operator id; ``sql`` is the same result in SQL, where there is one."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


from binfold.plans import q_cohort, q_models, q_relational, q_sources  # noqa: E402, F401
from binfold.plans import q_binary, q_cohort_run, q_more, q_regions  # noqa: E402, F401
