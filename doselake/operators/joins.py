"""Lookup chains, composite-key matching, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doselake.functions.chem import is_valid_structure
from doselake.functions.dose import clip_unit, log2_dose, sig3upper
from doselake.functions.ranking import blocked_row_number, seeded_hash
from doselake.functions.skew import dealt_rows, salted_join
from doselake.schema import require_columns

# Joins to dimension tables carry no hint: Spark broadcasts a side by its size
# and splits an oversized shuffle partition at run time.


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in a total order.

    ``rank = 1`` lets Spark keep one row per key on the map side already, so a
    hot key is shuffled as one row per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def attach_compounds(rows: DataFrame, compounds: DataFrame, order: list[str]) -> DataFrame:
    """Left join on the compound id; the first compound row per id counts."""
    first = keep_first(compounds, ["pert_id"], order)
    return rows.join(first, rows["pert_mfc_id"] == first["pert_id"], "left").drop("pert_id")


def lookup_chain(
    curves: DataFrame, per_experiment: DataFrame, per_cell_line: DataFrame, per_compound: DataFrame
) -> DataFrame:
    """Curves with cell name, external compound id, and compound name.

    Every dimension is reduced to its first row per key; curves lacking a cell
    or a compound are dropped.
    """
    exp = keep_first(per_experiment, ["experiment_id"], ["master_ccl_id"])
    ccl = keep_first(per_cell_line, ["master_ccl_id"], ["ccl_name"])
    cpd = keep_first(per_compound, ["master_cpd_id"], ["broad_cpd_id", "cpd_name"])
    named = (
        curves.join(exp.select("experiment_id", "master_ccl_id"), "experiment_id", "left")
        .join(ccl.select("master_ccl_id", "ccl_name"), "master_ccl_id", "left")
        .join(cpd.select("master_cpd_id", "broad_cpd_id", "cpd_name"), "master_cpd_id", "left")
    )
    return named.where(F.col("ccl_name").isNotNull() & F.col("broad_cpd_id").isNotNull())


def match_pairs(
    signatures: DataFrame, curves: DataFrame, cell: str = "cell_mfc_name", compound: str = "pert_mfc_id",
    curve_cell: str = "ccl_name", curve_compound: str = "broad_cpd_id",
) -> DataFrame:
    """All (signature, curve) pairs of equal cell and compound, hot pairs salted."""
    right = curves.withColumnsRenamed({curve_cell: cell, curve_compound: compound})
    return salted_join(signatures, right, [cell, compound])


def _with_strategy(signatures: DataFrame, curves: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Key A where a curve has it, key B otherwise, as ``strategy`` and ``_key``."""
    known = curves.select(
        F.col("ccl_name").alias("cell_mfc_name"), F.col("broad_cpd_id").alias(key_a)
    ).distinct().withColumn("_known", F.lit(True))
    return (
        signatures.join(known, ["cell_mfc_name", key_a], "left")
        .withColumn("strategy", F.when(F.col("_known"), F.lit(1)).otherwise(F.lit(2)))
        .withColumn("_key", F.when(F.col("_known"), F.col(key_a)).otherwise(F.col(key_b)))
        .drop("_known")
    )


def _keyed_curves(curves: DataFrame) -> DataFrame:
    """Every curve under both of its keys, shaped for one join."""
    both = F.array(
        F.struct(F.lit(1).alias("strategy"), F.col("broad_cpd_id").alias("_key")),
        F.struct(F.lit(2).alias("strategy"), F.col("cpd_name").alias("_key")),
    )
    rest = ["experiment_id", "master_cpd_id", "p1_center", "p2_slope", "p4_baseline"]
    return curves.select(F.col("ccl_name").alias("cell_mfc_name"), *rest, F.inline(both))


MATCH_KEYS = ["strategy", "cell_mfc_name", "_key"]


def fallback_sides(
    signatures: DataFrame, curves: DataFrame, key_a: str = "pert_mfc_id", key_b: str = "cmap_name"
) -> tuple[DataFrame, DataFrame]:
    """Signatures and curves under ``MATCH_KEYS``; their join is ``match_with_fallback``."""
    return _with_strategy(signatures, curves, key_a, key_b), _keyed_curves(curves)


def match_with_fallback(
    signatures: DataFrame, curves: DataFrame, key_a: str = "pert_mfc_id", key_b: str = "cmap_name"
) -> DataFrame:
    """Matched pairs; key B is used only for signatures key A cannot match.

    A curve goes through the signatures of its key, which are mostly the shorter
    list: in columnar files its columns are then runs, and the signatures' recur
    within a page, so many pairs of a key take few bytes.
    """
    flagged, keyed = fallback_sides(signatures, curves, key_a, key_b)
    rest = [c for df in (flagged, keyed) for c in df.columns if c not in MATCH_KEYS]
    return salted_join(keyed, flagged, MATCH_KEYS).select("strategy", "cell_mfc_name", *rest)


def matched_sides(
    signatures: DataFrame, curves: DataFrame, key_a: str = "pert_mfc_id", key_b: str = "cmap_name"
) -> tuple[DataFrame, DataFrame]:
    """The signatures that ``match_with_fallback`` matches, and the curves it matches them with; no pairs are made."""
    flagged, keyed = fallback_sides(signatures, curves, key_a, key_b)
    found = flagged.join(keyed.select(*MATCH_KEYS).distinct(), MATCH_KEYS, "left_semi")
    used = keyed.join(flagged.select(*MATCH_KEYS).distinct(), MATCH_KEYS, "left_semi")
    return found.drop("_key"), used.drop("_key", "strategy").distinct()


def _weighted_mean(weight: str, value: str) -> Column:
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return F.try_divide(F.sum(w * F.col(value)), F.sum(w))


def signature_viability(
    signatures: DataFrame, curves: DataFrame, combine: str = "mean", clip: bool = True,
    clip_exponent: bool = True, key_a: str = "pert_mfc_id", key_b: str = "cmap_name",
    first_curve: bool = False,
) -> DataFrame:
    """One viability per matched signature: the mean of its curves, or the first.

    ``first_curve`` also names the first curve next to the mean.

    Curves of equal parameters are counted and signatures of equal dose are
    merged before the join, so a hot (cell, compound) pair costs its distinct
    doses times its distinct curves, not all pairs of rows. What is added up
    over those are numbers, in hash tables as long as the doses; the first curve
    depends on the pair alone and is found apart.
    """
    curves = dealt_rows(curves, ["experiment_id", "master_cpd_id"])
    flagged = _with_strategy(signatures, curves, key_a, key_b)
    keyed = _keyed_curves(curves)
    params = ["p1_center", "p2_slope", "p4_baseline"]
    value = sig3upper(
        F.col("p1_center"), F.col("p2_slope"), F.col("p4_baseline"),
        log2_dose(F.col("pert_dose")), clip_exponent,
    )
    earliest = keep_first(keyed, MATCH_KEYS, ["experiment_id", "master_cpd_id"])
    if combine == "first":
        out = flagged.join(earliest, MATCH_KEYS).withColumn("viability", value)
    elif combine == "mean":
        together = F.struct(*MATCH_KEYS).alias("_pair")
        bag = keyed.groupBy(*MATCH_KEYS, *params).agg(F.count(F.lit(1)).alias("_w")).select(together, *params, "_w")
        doses = flagged.select(*MATCH_KEYS, "pert_dose").distinct().select("*", together)
        # joined on the struct but grouped by its fields: the exchange in between
        # leaves Spark free to split a partition that a hot pair makes too large
        means = (
            doses.join(bag, "_pair")
            .withColumn("_v", value)
            .groupBy(*MATCH_KEYS, "pert_dose")
            .agg(_weighted_mean("_w", "_v").alias("viability"), F.sum("_w").alias("n_curves"))
        )
        out = flagged.join(means, [*MATCH_KEYS, "pert_dose"])
        if first_curve:
            out = out.join(earliest.drop(*params), MATCH_KEYS)
    else:
        raise ValueError(f"combine must be 'mean' or 'first', not {combine}")
    out = out.drop("_key", *params)
    return out.withColumn("viability", clip_unit(F.col("viability"))) if clip else out


def usable_curves(curves: DataFrame, per_compound: DataFrame) -> DataFrame:
    """Curves of compounds with a usable structure.

    Taken before matching, so that a signature whose first curve has none still
    matches by a later curve or by the fallback key.
    """
    first = keep_first(per_compound, ["master_cpd_id"], ["cpd_smiles"])
    usable = first.where(is_valid_structure(F.col("cpd_smiles"))).select("master_cpd_id")
    return curves.join(usable, "master_cpd_id", "left_semi")


def attach_structure(matched: DataFrame, per_compound: DataFrame) -> DataFrame:
    """Structure string by compound id; rows without a usable one are dropped."""
    first = keep_first(per_compound, ["master_cpd_id"], ["cpd_smiles"])
    joined = matched.join(first.select("master_cpd_id", "cpd_smiles"), "master_cpd_id")
    return joined.where(is_valid_structure(F.col("cpd_smiles")))


def fetch_rows(matrix: DataFrame, ids: DataFrame) -> DataFrame:
    """Matrix rows of a list ``(list_pos, sig_id)``; the list order stays a column."""
    return matrix.join(ids.select("list_pos", "sig_id"), "sig_id")


def left_merge(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    return left.join(right, on, "left")


def exact_triplet_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on dose, cell and compound. The dose must be the same double."""
    return salted_join(left, right, ["pert_dose", "cell_mfc_name", "pert_mfc_id"])


def filter_to_known(df: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose value in every listed column occurs in ``other``."""
    for c in columns:
        df = df.join(other.select(c).distinct(), c, "left_semi")
    return df


def lookup_measurements(pairs: DataFrame, measurements: DataFrame) -> DataFrame:
    """Measurement rows of the listed (experiment, compound) pairs."""
    keys = ["experiment_id", "master_cpd_id"]
    return measurements.join(pairs.select(*keys).distinct(), keys)


def predictions_with_metadata(
    predictions: DataFrame, metadata: DataFrame, columns: list[str], key: str = "sig_id"
) -> DataFrame:
    require_columns(metadata, [key, *columns], KeyError, "metadata")
    return predictions.join(metadata.select(key, *columns), key)


def pair_controls(
    samples: DataFrame, control: Column, plate: str = "det_plate", key: str = "sample_id", seed: int = 42
) -> DataFrame:
    """Each treated sample with one control of its plate, drawn by hash.

    Treated samples of a plate without a control have no pair and are left out.
    Controls get a number per plate block by block, so a plate that holds a
    large share of the samples is ranked by many tasks.
    """
    tagged = samples.withColumn("_control", control)
    hashed = (
        tagged.where("_control").select(plate, F.col(key).alias("control_id"))
        .withColumn("_h", seeded_hash(seed, "control_id"))
    )
    sizes = hashed.groupBy(plate).agg(F.count(F.lit(1)).alias("_n"))
    # blocks of a plate share as many leading digits as leave some 10,000 controls in each
    digits = F.greatest(F.ceil(F.log(16.0, F.col("_n") / 10_000)), F.lit(0)).cast("int")
    numbered = blocked_row_number(
        hashed.join(sizes.withColumn("_d", digits), plate), [plate], [F.col("_h"), F.col("control_id")],
        F.substring("_h", F.lit(1), F.col("_d")), "_no",
    ).drop("_h", "_n", "_d")
    draw = F.conv(F.substring(seeded_hash(seed + 1, key), 1, 8), 16, 10).cast("bigint")
    treated = (
        tagged.where(~F.col("_control")).drop("_control")
        .join(sizes, plate)
        .withColumn("_no", F.pmod(draw, F.col("_n")) + 1)
        .drop("_n")
    )
    return salted_join(treated, numbered, [plate, "_no"]).drop("_no")


def structure_dictionary(compounds: DataFrame, order: list[str]) -> DataFrame:
    """One structure per compound id, first row wins, missing ones left out."""
    present = compounds.where(F.col("canonical_smiles").isNotNull())
    return keep_first(present, ["pert_id"], order).select("pert_id", "canonical_smiles")


def structure_length_limit(dictionary: DataFrame, cap: int) -> DataFrame:
    """Token length used for a dictionary: its longest string, at most ``cap``."""
    return dictionary.agg(
        F.least(F.max(F.length("canonical_smiles")), F.lit(cap)).alias("max_length")
    )


def shared_genes(network: DataFrame, genes: DataFrame, gene: str = "gene_symbol") -> tuple[DataFrame, DataFrame]:
    """Network edges and genes restricted to their common genes."""
    targets = network.select(F.col("target").alias(gene)).distinct()
    kept_genes = genes.join(targets, gene, "left_semi")
    names = genes.select(F.col(gene).alias("target")).distinct()
    kept_edges = network.join(names, "target", "left_semi")
    if kept_edges.isEmpty():
        raise ValueError("No shared genes found: no network target is a gene of the table")
    return kept_edges, kept_genes


def common_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def stack_tables(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables, columns matched by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def uncovered_pairs(second: DataFrame, first: DataFrame) -> DataFrame:
    """Pairs found by the second strategy only."""
    return second.subtract(first)


def stack_results(tables: dict[str, DataFrame], label: str = "method") -> DataFrame:
    """Result tables stacked, each under its method label."""
    return stack_tables([t.withColumn(label, F.lit(name)) for name, t in tables.items()])


def missing_genes(features: DataFrame, leaves: DataFrame, column: str = "node") -> DataFrame:
    """Feature names that are no leaf of the ontology."""
    return features.select(column).distinct().join(leaves.select(column), column, "left_anti")
