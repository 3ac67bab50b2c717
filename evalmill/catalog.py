"""All registered queries of the reference's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_PLANS = ("evaluation", "inference", "answers", "decisions", "pages", "relations", "files", "streams", "instrument", "judges", "preference", "selection", "derivation", "estimate")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query by its name; ``sql`` is its DuckDB form, None where SQL can't say it."""

    def keep(query: Query) -> Query:
        _queries[query.__name__] = query
        if sql:
            _sql[query.__name__] = sql
        return query

    return keep


def _load() -> None:
    for plan in _PLANS:
        import_module(f"evalmill.plans.{plan}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion by judge and by judge and criterion."""
    _load()
    return _queries["l1_by_criterion"](spark, sf_dir)
