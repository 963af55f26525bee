"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.exprs import published
from .sqlviews import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(body: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Registers a query under its function's name; its doubles are shown rounded."""

    def register(function: Query) -> Query:
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = function(spark, sf_dir)
            return df.select(*[published(df[c].cast("double")).alias(c) if t == "double" or t.startswith("decimal") else df[c] for c, t in df.dtypes])

        QUERIES[function.__name__] = shown
        if body is not None:
            ORACLE[function.__name__] = sql(body, doubles)
        return function

    return register


from . import calculator_queries, fit_queries, grid_queries, ledger_queries, lookup_queries, series_queries, summary_queries  # noqa: E402, F401
