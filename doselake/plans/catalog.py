"""Registry of queries: each a function of ``Tables``, with its SQL if it has one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doselake.plans.standins import Tables, with_views


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(Tables(spark, folder))


CATALOG: dict[str, Query] = {}


def query(sql: str | None = None, ints: tuple[str, ...] = ()) -> Callable:
    """Register a query under its function name; without SQL only rows are checked.

    ``ints`` names the SQL's columns to give as INTEGER, which Spark uses for
    positions and row numbers where SQL counts in BIGINT.
    """
    text = None if sql is None else with_views(sql)
    if ints:
        casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ints)
        text = f"SELECT * REPLACE ({casts}) FROM ({text})"

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        CATALOG[fn.__name__] = Query(fn, text)
        return fn

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero, as both engines print it."""
    name = c if isinstance(c, str) else None
    col = F.round((F.col(c) if name else c).cast("double"), digits) + F.lit(0.0)
    return col.alias(name) if name else col


def cells(df: DataFrame, key: str = "sig_id", values: str = "values", digits: int = 6) -> DataFrame:
    """Arrays as rows ``key, pos, x`` for comparison.

    The outer form is on purpose: for the inner one Spark adds a size filter
    that would evaluate a computed array a second time.
    """
    long = df.select(key, F.posexplode_outer(values).alias("pos", "x"))
    return long.select(key, "pos", r(F.col("x"), digits).alias("x"))
