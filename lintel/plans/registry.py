"""Where queries register themselves: a callable on (spark, sf_dir) and, if SQL can say it, its twin for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Registers a function under its name. ``uses`` names the domain views that ``sql`` reads."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = views.with_views(uses, sql)
        return f

    return register
