"""Queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def blanks_only(sql: str) -> str:
    """``trim(x)`` as ``trim(x, ' ')``: the checking engine's own takes off more than blanks."""
    out, i = [], 0
    while (at := sql.find("trim(", i)) >= 0:
        depth, end, quoted, second = 1, at + 5, False, False
        while depth:
            c = sql[end]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
                second |= c == "," and depth == 1
            end += 1
        out.append(sql[i : at + 5] + blanks_only(sql[at + 5 : end - 1]) + (")" if second else ", ' ')"))
        i = end
    return "".join(out) + sql[i:]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; without SQL it is tested otherwise."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = blanks_only(sql)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
