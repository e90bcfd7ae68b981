"""End-to-end plans: the matched data set, and preparation for training."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doselake.functions.dose import log2_dose
from doselake.operators import joins, matrix as M, select, split, stats


def matched_viability(
    siginfo: DataFrame, curves: DataFrame, per_experiment: DataFrame, per_cell_line: DataFrame,
    per_compound: DataFrame, combine: str = "mean",
) -> DataFrame:
    """Eligible signatures with their dose-response value, one row each."""
    eligible = select.filter_signatures(siginfo)
    named = joins.lookup_chain(curves, per_experiment, per_cell_line, per_compound)
    return joins.signature_viability(eligible, named, combine)


def viability_by_cell(viability: DataFrame) -> DataFrame:
    """Mean viability and matched signatures per cell line."""
    return viability.groupBy("cell_mfc_name").agg(
        F.avg("viability").alias("mean_viability"), F.count(F.lit(1)).alias("n_signatures"),
        F.sum((F.col("strategy") == 2).cast("bigint")).alias("n_fallback"),
    )


def matched_dataset(
    siginfo: DataFrame, curves: DataFrame, per_experiment: DataFrame, per_cell_line: DataFrame,
    per_compound: DataFrame, measurements: DataFrame,
) -> DataFrame:
    """Mean viability, log2 dose, first curve's structure and lowest concentration.

    Only curves of compounds with a usable structure are matched.
    """
    eligible = select.filter_signatures(siginfo)
    named = joins.lookup_chain(curves, per_experiment, per_cell_line, per_compound)
    usable = joins.usable_curves(named, per_compound)
    both = joins.signature_viability(eligible, usable, "mean", first_curve=True)
    with_low = stats.min_concentration(both, measurements)
    return joins.attach_structure(with_low, per_compound).withColumn(
        "dose_log2", log2_dose(F.col("pert_dose"))
    )


def prepare_training(
    rows: DataFrame, strategy: str = "mean", threshold: float = 3.0, group_by: str = "cell_mfc_name",
    test: float = 0.2, val: float = 0.1, seed: int = 42,
) -> tuple[DataFrame, PipelineModel]:
    """Impute, clip outliers, split by group, and scale with the training part's statistics."""
    filled = M.Imputer(strategy).fit(rows).transform(M.impute_metadata(rows, strategy))
    clipped = M.clip_outliers(filled, threshold).drop("n_clipped")
    parts = split.split_with_roles(
        select.drop_invalid_structure(clipped), "sig_id", test, val, seed, group_by
    )
    fitted = M.chain([M.StandardScaler()]).fit(parts.where("split = 'train'"))
    return fitted.transform(parts), fitted
