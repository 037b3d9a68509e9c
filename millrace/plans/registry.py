"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) function, and its SQL where SQL can express it."""

    def put(function):
        _QUERIES[name] = function
        if sql:
            _ORACLES[name] = sql
        return function

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["tfidf_topk_lang"](spark, sf_dir)


from millrace.plans import blocking_queries, context_queries, feature_queries, learning_queries, relational_queries, stream_queries, text_queries  # noqa: E402, F401
