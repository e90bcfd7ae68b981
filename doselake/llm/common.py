"""Helpers shared by the operators: tables, and row-wise Arrow stages of bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from doselake.session import stored  # noqa: F401  (the operators beside take it from here)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def arrow_map(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: StructType, rows: int = 512
) -> DataFrame:
    """``mapInArrow`` that hands ``fn`` at most ``rows`` rows at a time.

    ``fn`` gives a dict of columns in the order of ``schema``. What ``fn`` holds
    at once is bounded by ``rows`` texts, however large Spark's batches are.
    """
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                columns = fn(batch.slice(start, rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) if not isinstance(v, pa.Array) else v
                     for v, f in zip(columns.values(), out, strict=True)],
                    schema=out,
                )

    return df.mapInArrow(run, schema)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for the jobs that run inside, so that buffers on both sides stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
