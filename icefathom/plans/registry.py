"""Where the registered queries and their SQL twins are kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from icefathom.plans.views import with_views
from icefathom.session import apply_defaults

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query under its function name, with its SQL twin if any."""

    def keep(query: Query) -> Query:
        @wraps(query)
        def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(apply_defaults(spark), sf_dir)

        QUERIES[query.__name__] = ready
        if sql is not None:
            ORACLES[query.__name__] = with_views(sql, *views)
        return query

    return keep
