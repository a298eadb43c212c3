"""How a module of queries registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .views import oracle


def registry():
    """(queries, oracles, decorator): the decorator takes a name and, where SQL can express it, SQL."""
    queries, oracles = {}, {}

    def query(name: str, sql: str | None = None):
        def put(f):
            queries[name] = f
            if sql:
                oracles[name] = oracle(sql)
            return f

        return put

    return queries, oracles, query


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))
