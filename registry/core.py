"""Query registration: a Spark callable and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def rounded_columns(sql: str) -> dict[str, int]:
    """Columns that a statement rounds, ``round(..., digits) AS name``: sums whose last digits depend on their order."""
    found = {}
    for start in re.finditer(r"\bround\(", sql):
        depth, comma, i = 1, None, start.end()
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        name = re.match(r"\s+AS\s+(\w+)", sql[i:], re.I)
        if comma and name and sql[comma + 1:i - 1].strip().isdigit():
            found[name[1]] = int(sql[comma + 1:i - 1])
    return found


def query(name: str, sql: str | None = None):
    """Register a query. Doubles that its SQL rounds are rounded alike; all else is returned as the operator made it."""
    digits = rounded_columns(sql or "")

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return rounded(build(spark, sf), digits)

        run.__name__ = name
        run.build, run.digits = build, digits
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits[f.name]).alias(f.name) if f.name in digits and isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
