"""The registered queries by name, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task gets where its keys are dealt out.
ROWS = 100_000


def tasks(*tables: DataFrame) -> int:
    """Into how many parts to deal these tables out, so that what one task holds stays the same at any size: their rows are counted from metadata."""
    return max(t.count() for t in tables) // ROWS + 1
