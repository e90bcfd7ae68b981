"""Filters, projections and column edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doselake.functions.dose import clip_unit
from doselake.schema import FEATURE_SPACES, nan_to_null, require_columns


def filter_signatures(siginfo: DataFrame, hours: float = 24.0) -> DataFrame:
    """Signatures at one time point with a known dose."""
    return siginfo.where((F.col("pert_time") == hours) & nan_to_null(F.col("pert_dose")).isNotNull())


def filter_qc(samples: DataFrame, pert_type: str = "trt_cp") -> DataFrame:
    """Samples that passed quality control and are of one perturbation type."""
    return samples.where((F.col("qc_pass") == 1) & (F.col("pert_type") == pert_type))


def gene_positions(genes: DataFrame, space: str | list[str], mode: str = "exact") -> DataFrame:
    """Gene rows of a feature space.

    ``exact`` keeps the listed spaces (``all``: the three known ones);
    ``cumulative`` lets ``best inferred`` include landmark genes and ``all``
    every row.
    """
    require_columns(genes, ["feature_space"], ValueError, "gene table")
    wanted = [space] if isinstance(space, str) else list(space)
    known = set(FEATURE_SPACES) | {"all"}
    if any(w not in known for w in wanted):
        raise ValueError(f"unknown feature space in {wanted}, expected one of {sorted(known)}")
    if mode == "cumulative":
        if "all" in wanted:
            return genes
        if "best inferred" in wanted:
            wanted = wanted + ["landmark"]
    elif mode == "exact":
        wanted = list(FEATURE_SPACES) if "all" in wanted else wanted
    else:
        raise ValueError(f"unknown mode: {mode}")
    kept = genes.where(F.col("feature_space").isin(wanted))
    if kept.isEmpty():  # one row per gene, so the check is cheap
        raise ValueError(f"no gene belongs to {wanted}")
    return kept


def pick_genes(matrix: DataFrame, genes: DataFrame) -> DataFrame:
    """Matrix reduced to the listed genes, in gene-table order.

    The position list is a one-row subquery as wide as the gene table, so no
    join and no shuffle of the matrix takes place.
    """
    idx = genes.agg(F.array_sort(F.collect_list(F.col("pos").cast("int"))))
    return (
        matrix.withColumn("_idx", idx.scalar())
        .withColumn("values", F.transform("_idx", lambda i: F.get("values", i)))
        .drop("_idx")
    )


def select_genes(
    matrix: DataFrame, genes: DataFrame, space: str | list[str], mode: str = "exact"
) -> DataFrame:
    return pick_genes(matrix, gene_positions(genes, space, mode))


def landmark_view(matrix: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Landmark values, and the gene table giving each new position its symbol."""
    kept = gene_positions(genes, "landmark")
    listed = kept.agg(F.array_sort(F.collect_list(F.struct("pos", "gene_symbol"))).alias("g"))
    names = listed.select(F.posexplode("g").alias("pos", "_g")).select(
        "pos", F.col("_g.gene_symbol").alias("gene_symbol"), F.col("_g.pos").alias("source_pos")
    )
    return pick_genes(matrix, kept), names


def take_rows(df: DataFrame, n: int, order: str = "row_no") -> DataFrame:
    """First ``n`` rows in stored order (a top-k, not a full sort)."""
    return df.orderBy(order).limit(n)


def drop_incomplete(df: DataFrame, columns: list[str], values: str = "values") -> DataFrame:
    """Rows without a missing metadata value and without a missing gene."""
    require_columns(df, columns)
    gap = F.exists(values, lambda x: x.isNull() | F.isnan(x))
    return df.na.drop(subset=columns).where(~gap)


def drop_invalid_structure(df: DataFrame, column: str = "canonical_smiles") -> DataFrame:
    """Rows with a non-empty structure string; a table without the column is kept."""
    if column not in df.columns:
        return df
    return df.where(F.col(column).isNotNull() & (F.length(column) > 0))


def normalise_dose_units(
    df: DataFrame, control: Column, dose: str = "pert_dose", unit: str = "pert_dose_unit",
    known: tuple[str, ...] = ("uM",),
) -> DataFrame:
    """Controls and rows of an unknown unit get dose 0 in ``uM``."""
    reset = control | F.col(unit).isNull() | ~F.col(unit).isin(*known)
    return df.withColumn(dose, F.when(reset, F.lit(0.0)).otherwise(F.col(dose))).withColumn(
        unit, F.when(reset, F.lit("uM")).otherwise(F.col(unit))
    )


# Column names of the screening table as the matching step wants them.
MATCH_NAMES = {
    "cpd_conc_umol": "pert_dose",
    "ccl_name": "cell_mfc_name",
    "broad_cpd_id": "pert_mfc_id",
    "cpd_pred_pv": "viability_score",
}


def rename_for_match(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed(names or MATCH_NAMES)


def add_constant(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.withColumn(column, F.lit(value))


def merge_target(
    features: DataFrame, target: DataFrame, key: str = "sig_id",
    columns: tuple[str, ...] = ("viability", "cell_mfc_name", "pert_dose"),
) -> DataFrame:
    """Features, then the three target columns."""
    require_columns(target, [key, *columns], KeyError, "target table")
    return features.join(target.select(key, *columns), key)


def gene_symbols(ids: DataFrame, genes: DataFrame, key: str = "gene_id") -> DataFrame:
    """Symbol per gene id, ``Gene_<id>`` when the gene table lacks it."""
    named = ids.join(genes.select(key, "gene_symbol"), key, "left")
    fallback = F.concat(F.lit("Gene_"), F.col(key).cast("string"))
    return named.withColumn("gene_symbol", F.coalesce("gene_symbol", fallback))


def collapse_duplicate_genes(matrix: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One value per symbol: the mean over its positions, missing values skipped.

    Works row by row on the array; returns the matrix and its new gene table.
    """
    per_symbol = genes.groupBy("gene_symbol").agg(
        F.min("pos").alias("first"), F.array_sort(F.collect_list(F.col("pos").cast("int"))).alias("at")
    )
    listed = per_symbol.agg(F.array_sort(F.collect_list(F.struct("first", "gene_symbol", "at"))).alias("g"))

    def mean_at(g: Column) -> Column:
        x = F.filter(
            F.transform(g["at"], lambda i: F.get("values", i).cast("double")),
            lambda v: v.isNotNull() & ~F.isnan(v),
        )
        total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
        return F.try_divide(total, F.size(x).cast("double"))

    out = (
        matrix.withColumn("_g", listed.scalar())
        .withColumn("values", F.transform("_g", mean_at))
        .drop("_g")
    )
    names = listed.select(F.posexplode("g").alias("pos", "_g")).select(
        "pos", F.col("_g.gene_symbol").alias("gene_symbol"), F.size("_g.at").alias("n_merged")
    )
    return out, names


def clip_viability(df: DataFrame, column: str = "viability") -> DataFrame:
    return df.withColumn(column, clip_unit(F.col(column)))


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def fill_zero(df: DataFrame, values: str | None = None) -> DataFrame:
    """Missing features become 0, in an array column or in all numeric columns."""
    if values is None:
        return df.na.fill(0)
    return df.withColumn(
        values,
        F.transform(values, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)),
    )


SAMPLE_PARTS = ("transcriptomics", "molecular", "dosage", "viability")


def sample_view(df: DataFrame, parts: tuple[str, ...], key: str = "sig_id") -> DataFrame:
    """``key, sample`` with the chosen parts of a sample as one struct."""
    require_columns(df, [key, *parts], KeyError, "samples")
    return df.select(key, F.struct(*parts).alias("sample"))


def multimodal_view(df: DataFrame, key: str = "sig_id") -> DataFrame:
    return sample_view(df, SAMPLE_PARTS, key)


def transcriptomics_view(df: DataFrame, key: str = "sig_id") -> DataFrame:
    return sample_view(df, ("transcriptomics", "viability"), key)


def chemical_view(df: DataFrame, key: str = "sig_id") -> DataFrame:
    return sample_view(df, ("molecular", "dosage", "viability"), key)
