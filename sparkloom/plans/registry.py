"""Where queries and their SQL are registered, and what their definitions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(F.col(n).cast("double"), 6))
    return df


def longs(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.col(n).cast("bigint"))
    return df


GAP = "letter IN ('-', '.')"
N = "CAST({} AS BIGINT)".format
R = "round(CAST({} AS DOUBLE), 6)".format
COUNTS = f"""counts AS (SELECT msa_id, col, count(*) AS n_rows, count(*) FILTER ({GAP}) AS gaps,
  count(*) FILTER (NOT {GAP} AND letter <> lower(letter)) AS uppers, count(*) FILTER (NOT {GAP} AND letter <> upper(letter)) AS lowers,
  count(*) FILTER (letter = '.') AS dots, count(*) FILTER (letter = '-') AS dashes FROM {{}} GROUP BY msa_id, col)"""
PLACED = "{0}_pos AS (SELECT *, sum(CASE WHEN " + GAP + " THEN 0 ELSE 1 END) OVER (PARTITION BY msa_id, seq_id ORDER BY col) AS n FROM {0})"
