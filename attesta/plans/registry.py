"""Where queries are registered, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def tok_sql(x: str) -> str:
    """SQL of a text's tokens; a regular expression engine without look-around removes thousands separators by shape."""
    return (
        f"list_transform(regexp_extract_all(lower({x}), '\\d+(?:[.,]\\d+)*|[a-z]+'), "
        "lambda t: CASE WHEN regexp_matches(t, '^\\d{1,3}(,\\d{3})+(\\.\\d+)?$') THEN replace(t, ',', '') ELSE t END)"
    )


def gram_sql(t: str) -> str:
    """SQL of the triples of a list of tokens."""
    return f"list_transform(range(1, len({t}) - 1), lambda i: {t}[i] || ' ' || {t}[i + 1] || ' ' || {t}[i + 2])"
