"""Expression matrix container: four Parquet tables below one path.

``matrix(row_no, sig_id, values)``, ``rows(row_no, sig_id, id, ...)``,
``genes(pos, id, ...)`` and ``attributes(attributes)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doselake import schema as S
from doselake.operators.select import gene_positions, pick_genes

Selection = slice | Sequence[int] | None


def write_matrix(
    matrix: DataFrame, rows: DataFrame, genes: DataFrame, attributes: dict[str, str], path: str,
    codec: str = "zstd",
) -> str:
    """Write values as float32 with row table, gene table, and attributes."""
    S.require_columns(matrix, ["row_no", "sig_id", "values"], what="matrix")
    S.require_columns(rows, ["sig_id"], what="rows")
    S.require_columns(genes, ["pos"], what="genes")

    def put(df: DataFrame, part: str) -> None:
        df.write.option("compression", codec).parquet(f"{path}/{part}")

    put(matrix.withColumn("values", F.col("values").cast("array<float>")), "matrix")
    put(rows if "id" in rows.columns else rows.withColumn("id", F.col("sig_id")), "rows")
    put(genes if "id" in genes.columns else genes.withColumn("id", F.col("pos")), "genes")
    spark = matrix.sparkSession
    pairs = [F.lit(v) for kv in attributes.items() for v in kv]
    attrs = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    put(spark.range(1).select(attrs.cast("map<string,string>").alias("attributes")), "attributes")
    return path


def _select_rows(df: DataFrame, rows: Selection | DataFrame) -> DataFrame:
    """Row selection by slice, by list (order kept in ``list_pos``), or by a table of ids."""
    if rows is None:
        return df
    if isinstance(rows, DataFrame):
        return df.join(rows, "sig_id")
    if isinstance(rows, slice):
        start, step = rows.start or 0, rows.step or 1
        if start < 0 or step < 1 or (rows.stop is not None and rows.stop < 0):
            raise IndexError("slices count from the first row")
        out = df.where(F.col("row_no") >= start)
        if rows.stop is not None:
            out = out.where(F.col("row_no") < rows.stop)
        return out if step == 1 else out.where((F.col("row_no") - start) % step == 0)
    wanted = [int(i) for i in rows]
    n = df.count()
    if any(i < 0 or i >= n for i in wanted):
        raise IndexError(f"row numbers must lie in 0..{n - 1}")
    listed = df.sparkSession.createDataFrame(
        list(enumerate(wanted)), "list_pos BIGINT, row_no BIGINT"
    )
    return df.join(listed, "row_no")


def read_matrix(
    spark: SparkSession, path: str, rows: Selection | DataFrame = None, genes: Selection = None,
    feature_space: str | list[str] | None = None,
) -> DataFrame:
    """Rows and genes of the stored matrix; a gene list or a feature space, not both."""
    if genes is not None and feature_space is not None:
        raise ValueError("give a gene selection or a feature space, not both")
    df = _select_rows(spark.read.parquet(f"{path}/matrix"), rows)
    if feature_space is not None:
        gene_table = spark.read.parquet(f"{path}/genes")
        return pick_genes(df, gene_positions(gene_table, feature_space))
    if genes is None:
        return df
    if isinstance(genes, slice):
        start, step = genes.start or 0, genes.step or 1
        stop = F.size("values") if genes.stop is None else F.least(F.size("values"), F.lit(genes.stop))
        idx = F.when(stop > start, F.sequence(F.lit(start), stop - 1, F.lit(step)))
        idx = F.coalesce(idx, F.array().cast("array<int>"))
        return df.withColumn("values", F.transform(idx, lambda i: F.get("values", i)))
    width = spark.read.parquet(f"{path}/genes").count()
    if any(i < 0 or i >= width for i in genes):
        raise IndexError(f"gene positions must lie in 0..{width - 1}")
    idx = F.lit([int(i) for i in genes]).cast("array<int>")
    return df.withColumn("values", F.transform(idx, lambda i: F.get("values", i)))


def read_row_metadata(
    spark: SparkSession, path: str, columns: list[str] | str | None = None,
    rows: Selection | DataFrame = None,
) -> DataFrame:
    """Chosen columns of chosen rows; an unknown column raises ``KeyError``."""
    df = spark.read.parquet(f"{path}/rows")
    cols = [columns] if isinstance(columns, str) else (columns or df.columns)
    S.require_columns(df, cols, what="row metadata")
    kept = _select_rows(df, rows)
    extra = ["list_pos"] if "list_pos" in kept.columns else []
    return kept.select(*cols, *extra)


def read_gene_metadata(
    spark: SparkSession, path: str, columns: list[str] | str | None = None,
    genes: Selection = None, feature_space: str | list[str] | None = None,
) -> DataFrame:
    """Chosen columns of the gene table, by position or feature space."""
    df = spark.read.parquet(f"{path}/genes")
    cols = [columns] if isinstance(columns, str) else (columns or df.columns)
    S.require_columns(df, cols, what="gene metadata")
    if feature_space is not None:
        df = gene_positions(df, feature_space)
    elif isinstance(genes, slice):
        start, step = genes.start or 0, genes.step or 1
        df = df.where((F.col("pos") >= start) & ((F.col("pos") - start) % step == 0))
        df = df if genes.stop is None else df.where(F.col("pos") < genes.stop)
    elif genes is not None:
        df = df.where(F.col("pos").isin([int(i) for i in genes]))
    return df.select(*cols)


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """The dataset attributes as a one-row map."""
    return spark.read.parquet(f"{path}/attributes")


def read_data_with_metadata(
    spark: SparkSession, path: str, rows: Selection | DataFrame = None,
    feature_space: str | list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Matrix joined to row metadata on ``sig_id``, and the matching gene table."""
    data = read_matrix(spark, path, rows, feature_space=feature_space)
    meta = spark.read.parquet(f"{path}/rows").drop("row_no")
    return data.join(meta, "sig_id"), read_gene_metadata(spark, path, feature_space=feature_space)


def validate_container(spark: SparkSession, path: str) -> DataFrame:
    """One row per check: ``(check, expected, actual, ok)``.

    Row ids are compared, not counted: ``rows_match_ids`` expects as many as
    either table has, and finds those that both have.
    """
    matrix = spark.read.parquet(f"{path}/matrix")
    rows = spark.read.parquet(f"{path}/rows")
    genes = spark.read.parquet(f"{path}/genes")
    m = matrix.agg(
        F.count(F.lit(1)).alias("stored"),
        F.min(F.size("values")).alias("lo"), F.max(F.size("values")).alias("hi"),
    )
    # ids that only one side has, or has more often, are no matches
    mine = matrix.groupBy(F.col("sig_id").cast("string").alias("i")).agg(F.count(F.lit(1)).alias("a"))
    theirs = rows.groupBy(F.col("id").cast("string").alias("i")).agg(F.count(F.lit(1)).alias("b"))
    same = mine.join(theirs, "i").agg(F.coalesce(F.sum(F.least("a", "b")), F.lit(0)))
    # a gene table numbers the places of the values, each once
    placed = genes.select("pos", "id").where("id IS NOT NULL AND pos >= 0").agg(F.countDistinct(F.when(F.col("pos") < genes.count(), F.col("pos"))))
    stored = matrix.schema["values"].dataType.simpleString()
    one = (
        m.withColumn("row_ids", rows.agg(F.count("id")).scalar()).withColumn("n", same.scalar())
        .withColumn("row_ids", F.greatest("row_ids", "stored"))
        .withColumn("gene_ids", placed.scalar())
    )
    checks = [
        ("rows_match_ids", F.col("row_ids").cast("string"), F.col("n").cast("string")),
        ("narrowest_row_matches_genes", F.col("gene_ids").cast("string"), F.col("lo").cast("string")),
        ("widest_row_matches_genes", F.col("gene_ids").cast("string"), F.col("hi").cast("string")),
        ("value_type", F.lit("array<float>"), F.lit(stored)),
    ]
    return one.select(
        F.inline(F.array(*[
            F.struct(
                F.lit(name).alias("check"), e.alias("expected"), a.alias("actual"),
                F.coalesce((e == a).cast("int"), F.lit(0)).alias("ok"),
            )
            for name, e, a in checks
        ]))
    )
