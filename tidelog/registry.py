"""The registered log-analytics queries and their SQL oracles."""

from __future__ import annotations

from tidelog.plans import contracts, logs, operations


def queries() -> dict:
    return {**logs.QUERIES, **operations.QUERIES, **contracts.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**logs.SQL, **operations.SQL, **contracts.SQL}
