"""Queries of the engine's own operators and the SQL that checks them."""

from __future__ import annotations

from .queries import QUERIES
from .sql import SQL


def entry(spark, sf_dir: str):
    return QUERIES["barrier_results"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
