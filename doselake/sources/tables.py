"""Delimited and binary inputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doselake import schema as S
from doselake.functions.ranking import beyond_cuts, seeded_hash
from doselake.sources.flat import read_flat_matrix


def _read_delimited(
    spark: SparkSession, path: str, sep: str, schema: str, columns: list[str] | None, header: bool
) -> DataFrame:
    try:
        df = spark.read.csv(path, sep=sep, header=header, schema=schema, nullValue="")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    if columns is not None:
        df = S.require_columns(df, columns, what=path).select(*columns)
    return df


def read_tsv(
    spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, header: bool = True
) -> DataFrame:
    """Tab-separated table with an explicit schema (no inference pass)."""
    return _read_delimited(spark, path, "\t", schema, columns, header)


def read_csv(
    spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, header: bool = True
) -> DataFrame:
    """Comma-separated table; only the named columns are parsed."""
    return _read_delimited(spark, path, ",", schema, columns, header)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, of smallest ``md5(seed:key)``; all rows when there are fewer.

    Finding the cut costs two narrow passes, and the rows themselves are only
    filtered, so a large sample is never sorted in one place. A null key counts
    as empty; rows of the key that the cut divides go in the order of their columns.
    """
    hashed = df.withColumn("_h", seeded_hash(seed, key))
    placed = beyond_cuts(hashed, "_h", lambda total: [F.least(F.lit(n).cast("bigint"), total)], out="_beyond")
    return placed.where("_beyond = 0").drop("_h", "_beyond")


def read_csv_sampled(
    spark: SparkSession,
    path: str,
    schema: str,
    sample_size: int | None = None,
    use_chunks: bool = False,
    chunk_size: int = 10_000,
    key: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """All rows, the first ``sample_size``, or a drawn sample (``use_chunks``).

    ``chunk_size`` is validated only: Spark splits the file itself.
    """
    if sample_size is not None and sample_size <= 0:
        raise ValueError("sample_size must be positive")
    if chunk_size <= 0:
        raise ValueError("chunk_size must be positive")
    df = read_csv(spark, path, schema)
    if sample_size is None:
        return df
    if not use_chunks:
        return df.limit(sample_size)
    return sample_rows(df, sample_size, key or df.columns[0], seed)


def read_edges(spark: SparkSession, path: str, kind: str = "network", sep: str = "\t") -> DataFrame:
    """A regulatory network (with header) or an ontology (without)."""
    if kind == "ontology":
        return _read_delimited(spark, path, sep, S.ONTOLOGY, None, header=False)
    if kind != "network":
        raise ValueError(f"unknown edge list kind: {kind}")
    names = spark.read.csv(path, sep=sep, header=True).columns
    absent = {"source", "target", "weight"} - set(names)
    if absent:
        raise ValueError(f"network lacks the columns {sorted(absent)}")
    types = {"weight": "DOUBLE"}
    ddl = ", ".join(f"`{c}` {types.get(c, 'STRING')}" for c in names)
    return _read_delimited(spark, path, sep, ddl, ["source", "target", "weight"], header=True)


def read_binary_matrix(
    spark: SparkSession, path: str, rows: int, cols: int, dtype: str = "float64",
    row_ids: DataFrame | None = None, n_genes: int | None = None,
) -> DataFrame:
    """Flat row-major file (or folder of parts) to ``(row_no, values)``; ``row_ids(row_no, sig_id)`` joins ids.

    Read by byte ranges of whole rows through the ``flat_matrix`` data source.
    """
    if n_genes is not None and n_genes != cols:
        raise ValueError(f"gene table has {n_genes} rows, the matrix {cols} columns")
    matrix = read_flat_matrix(spark, path, rows, cols, dtype)
    if row_ids is not None and row_ids.count() != rows:
        raise ValueError("row table does not match the number of matrix rows")
    matrix = matrix.withColumn("values", S.nan_to_null_array(F.col("values")))
    if row_ids is not None:
        matrix = matrix.join(row_ids, "row_no")
    return matrix
