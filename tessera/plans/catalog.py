"""Registered queries of the ownership engine and the SQL that checks them."""

from __future__ import annotations

from tessera.plans import pipeline_queries, queries, source_queries  # noqa: F401  (they register)
from tessera.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
