"""All registered queries of the reconciliation operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyweave.plans import balances, decisions, linking, lists, reporting, scalar, transfer

MODULES = [scalar, linking, reporting, balances, decisions, lists, transfer]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        if twice := out.keys() & m.QUERIES.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
