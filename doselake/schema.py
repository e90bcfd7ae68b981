"""Table schemas, column checks, and the NaN-to-NULL rule."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGINFO = (
    "sig_id STRING, cell_mfc_name STRING, pert_mfc_id STRING, cmap_name STRING, "
    "pert_dose DOUBLE, pert_time DOUBLE"
)
GENEINFO = "gene_id INT, gene_symbol STRING, feature_space STRING"
CURVES = (
    "experiment_id BIGINT, master_cpd_id BIGINT, p1_center DOUBLE, p2_slope DOUBLE, "
    "p4_baseline DOUBLE"
)
CONCENTRATIONS = (
    "experiment_id BIGINT, master_cpd_id BIGINT, cpd_conc_umol DOUBLE, "
    "cpd_avg_pv DOUBLE, cpd_pred_pv DOUBLE"
)
PER_EXPERIMENT = "experiment_id BIGINT, master_ccl_id BIGINT"
PER_CELL_LINE = "master_ccl_id BIGINT, ccl_name STRING"
PER_COMPOUND = (
    "master_cpd_id BIGINT, broad_cpd_id STRING, cpd_name STRING, cpd_smiles STRING"
)
NETWORK = "source STRING, target STRING, weight DOUBLE"
ONTOLOGY = "parent STRING, child STRING, relationship STRING"
MATRIX = "row_no BIGINT, sig_id STRING, values ARRAY<FLOAT>"

# The known feature spaces of the gene table.
FEATURE_SPACES = ("landmark", "best inferred", "inferred")


def require_columns(
    df: DataFrame, columns: Iterable[str], error: type[Exception] = KeyError, what: str = "table"
) -> DataFrame:
    """Fail before any job runs when a named column is absent."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise error(f"Missing columns in {what}: {absent}")
    return df


def nan_to_null(col: Column) -> Column:
    """Missing values are NULL everywhere; a stored NaN counts as missing."""
    return F.nanvl(col, F.lit(None).cast("double"))


def nan_to_null_array(col: Column) -> Column:
    return F.transform(col, lambda x: F.when(~F.isnan(x), x))
