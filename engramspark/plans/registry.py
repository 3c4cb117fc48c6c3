"""Registry of queries: name, plan and, where SQL can express it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


DELTA = "CASE evidence_level WHEN 'official' THEN 0.15E0 WHEN 'corroborated' THEN 0.08E0 WHEN 'unverified' THEN -0.1E0 ELSE 0E0 END"
RECENCY = "0.12E0 * exp(-ln(2E0) * age_days / 45E0)"


def tokens_sql(text: str) -> str:
    """The set of Unicode words of three characters or more, as SQL."""
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}]+'), lambda x: length(x) > 2))"


def jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {both} * 1.0E0 / (len({a}) + len({b}) - {both}) ELSE 0E0 END"
