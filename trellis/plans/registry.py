"""Every registered query of the library proper: name, DataFrame plan and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a plan under its function's name, with the SQL for the same rows where there is any."""

    def put(f: Query) -> Query:
        if f.__name__ in _queries:
            raise ValueError(f"two queries are named {f.__name__}")
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return put


def _load() -> None:
    from . import cleaning, contexts, episodes, groups, rows, sequences, state, texts, training, transcripts  # noqa: F401  they register as they load


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal advantages of every rollout in its group."""
    return queries()["group_terminal_advantage"](spark, sf_dir)
