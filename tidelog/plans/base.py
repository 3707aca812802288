"""What the query modules share: where queries and their SQL are noted, and the tables as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def key_sql(c: str) -> str:
    """A number's key, as ``changelog.ordered_key`` makes it."""
    return f"((CASE WHEN {c} < 0 THEN '0' ELSE '1' END) || lpad(({c}::BIGINT & 9223372036854775807)::VARCHAR, 19, '0'))"


CL = f"""
WITH cl AS (
  SELECT event_id // 1000 AS segment, event_id AS seq, (event_type = 'error')::INT AS op,
         {key_sql("user_id")} AS key, props AS value, ts
  FROM events
), top AS (
  SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY segment DESC, seq DESC) AS rn FROM cl) WHERE rn = 1
), flat AS (
  SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY segment, key ORDER BY seq DESC) AS rn FROM cl) WHERE rn = 1
)
"""
#: Bytes of a change's key and value; a tombstone's value has none.
SIZE = "(strlen(key) + CASE WHEN op = 0 THEN coalesce(strlen(value), 0) ELSE 0 END)"


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add
