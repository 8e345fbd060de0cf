"""Where queries register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tessera.plans.domain import SQL, Domain

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None, domain: bool = True) -> Callable:
    """Register a function of a Domain; ``sql`` goes after the domain's common table expressions."""

    def register(function: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: function(Domain(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = SQL + sql if domain else sql
        return function

    return register
