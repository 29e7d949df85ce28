"""The registered queries of the library's own operators, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("compare", "quality", "scans", "metrics", "texts", "graphs", "telemetry", "sources", "findings")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str | Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) and the SQL that gives the same rows."""

    def put(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return put


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"plumbline.plans.{family}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: oracle_of(name) for name in _ORACLES}


def oracle_of(name: str) -> str:
    sql = _ORACLES[name]
    return sql if isinstance(sql, str) else sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["cmp_keyed_diff"](spark, sf_dir)
