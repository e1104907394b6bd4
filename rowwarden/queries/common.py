"""Shared parts of the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """QUERIES, SQL and a decorator that files a query under its function's name, with its SQL."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def register(text: str | None = None):
        def put(f: Query) -> Query:
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return put

    return queries, sql, register


def joined(c: Column | str) -> Column:
    """An array as one text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def sql_fold(x: str) -> str:
    return f"regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g')"


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(lower({sql_fold(x)}), '[^a-z0-9]+', ' ', 'g'))"


def sql_normalise(x: str) -> str:
    return f"trim(regexp_replace(upper({sql_fold(x)}), '\\s+', ' ', 'g'))"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: A row a file, made of events: the same expressions in both engines.
FACTS = [
    "event_id AS id", "concat('d', user_id % 40) AS dataset", "concat(event_type, ' ', event_id % 90) AS name", "concat('https://h', user_id % 7, '.example/f/', event_id % 90, '.csv') AS url",
    "CASE WHEN user_id % 29 = 0 THEN NULL ELSE concat('h', user_id % 7) END AS host", "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'unknown' ELSE concat('', (event_id * 7919) % 900000000) END AS size",
    "CASE event_id % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'zip' WHEN 2 THEN 'json' WHEN 3 THEN 'xml' END AS candidate", "CAST(event_id % 4 AS INT) AS level",
    "CASE WHEN event_id % 10 = 0 THEN 'error' WHEN event_id % 10 = 1 THEN 'empty' WHEN event_id % 10 = 2 THEN 'not-tabular' WHEN event_id % 10 = 3 THEN NULL ELSE 'ok' END AS status",
    "CASE WHEN event_id % 10 = 2 THEN CASE WHEN event_id % 3 = 0 THEN 'no-tables' WHEN event_id % 3 = 1 THEN 'too-large' ELSE 'html' END END AS not_tabular_kind",
    "CASE WHEN event_id % 10 = 0 THEN CASE (event_id / 10) % 6 WHEN 0 THEN 'HTTPError: 404 Client Error: x' WHEN 1 THEN 'InvalidURL: none' WHEN 2 THEN 'TooManyRedirects: 30' WHEN 3 THEN 'ReadTimeout: 60' WHEN 4 THEN 'HTTPError: 503 Server Error' ELSE 'boom' END END AS error",
    "CASE event_id % 3 WHEN 0 THEN 'attached' WHEN 1 THEN 'declared' ELSE 'datastore' END AS schema_kind", "CASE WHEN event_id % 10 > 3 AND event_id % 3 <> 0 THEN value > 20 END AS passed", "CAST(event_id % 2 AS INT) AS missing", "CAST(event_id % 7 AS INT) AS undeclared",
    "CASE WHEN event_id % 5 = 4 THEN 0.02 ELSE 0.001 END AS error_rate", "CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id * 31) % 5000000 + 1 END AS bytes", "(event_id % 60) * 0.5 + 0.25 AS seconds", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 23) * 0.125 END AS first_byte_s",
    "CASE WHEN event_id % 6 = 0 THEN (event_id % 60) * 0.25 END AS download_s", "CASE WHEN event_id % 3 = 0 THEN (event_id % 60) * 0.125 END AS network_s", "CASE WHEN event_id % 6 = 0 THEN 'zip' WHEN event_id % 6 = 1 THEN 'txt' ELSE 'csv' END AS kind", "CASE WHEN event_id % 3 = 0 THEN 'e' END AS etag",
    "CASE WHEN event_id % 4 = 0 THEN 'm' END AS last_modified", "CASE WHEN event_id % 5 <> 0 THEN event_id END AS content_length", "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 'application/octet-stream' ELSE 'text/csv' END AS content_type",
]
# whole-number division differs between the engines
SPARK_FACTS = [x.replace("(event_id / 10)", "(event_id DIV 10)") for x in FACTS]
SQL_FACTS = "SELECT " + ", ".join(x.replace("(event_id / 10)", "(event_id // 10)") for x in FACTS) + " FROM events"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*SPARK_FACTS)
