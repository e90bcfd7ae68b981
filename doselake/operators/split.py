"""Deterministic splits of exact size.

A row's part depends on where ``md5(seed:key)`` falls among a few cut points.
Finding the cuts counts hash prefixes and sorts one bucket; labelling is a
projection. Only rows of a key that a cut divides are ever numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from doselake.functions.quantiles import exact_quantiles
from doselake.functions.ranking import beyond_cuts, hash_cuts, seeded_hash
from doselake.session import cut_lineage


def _check(test: float, val: float) -> None:
    if test + val >= 1.0:
        raise ValueError("test and val together must leave a training part")


def _ends(test: float, val: float):
    """Last ranks of the test and validation parts, rounded up as usual."""
    def targets(n: Column) -> list[Column]:
        n_test = F.ceil(n * F.lit(float(test)))
        n_val = F.ceil((n - n_test) * F.lit(float(val) / (1.0 - float(test))))
        return [n_test, n_test + n_val]
    return targets


def _label(h: Column, cuts: Column) -> Column:
    return (
        F.when(h <= F.try_element_at(cuts, F.lit(0)), "test")
        .when(h <= F.try_element_at(cuts, F.lit(1)), "val")
        .otherwise("train")
    )


def _named(beyond: str) -> Column:
    """Part of a row that lies beyond none, one, or both ends."""
    return F.when(F.col(beyond) == 0, "test").when(F.col(beyond) == 1, "val").otherwise("train")


def split_random(df: DataFrame, key: str, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``split``: test first, then ``val / (1 - test)`` of the rest.

    Sizes are exact for repeating and null keys too: rows of the one key that
    a part's end divides are taken in the order of their columns.
    """
    _check(test, val)
    hashed = df.withColumn("_h", seeded_hash(seed, key))
    placed = beyond_cuts(hashed, "_h", _ends(test, val), out="_beyond")
    return placed.withColumn("split", _named("_beyond")).drop("_h", "_beyond")


def split_group(df: DataFrame, group: str, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Whole groups go to one part; fractions count groups. Null and empty are one group."""
    _check(test, val)
    unit = F.coalesce(F.col(group).cast("string"), F.lit(""))
    groups = df.select(unit.alias("_g")).distinct()
    if groups.limit(3).count() < 3:
        raise ValueError(f"group split needs at least 3 groups of {group}")
    # one row, stored because every pass over the split rows needs it
    cuts = cut_lineage(
        hash_cuts(groups.withColumn("_h", seeded_hash(seed, "_g")), "_h", _ends(test, val)).select("cuts")
    )
    h = seeded_hash(seed, unit)
    return df.withColumn("_cuts", cuts.scalar()).withColumn("split", _label(h, F.col("_cuts"))).drop("_cuts")


def quantile_bins(df: DataFrame, column: str, bins: int = 10, out: str = "stratum") -> DataFrame:
    """Bin number by exact quantile edges, equal edges merged, right edge closed."""
    probs = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(df, [], column, probs).select(F.array_distinct("q"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(column).cast("double")))
    return df.withColumn("_edges", edges.scalar()).withColumn(
        out, F.when(F.col(column).isNotNull(), F.greatest(below - 1, F.lit(0)))
    ).drop("_edges")


def split_stratified(
    df: DataFrame, key: str, column: str, test: float = 0.2, val: float = 0.1, seed: int = 42, bins: int = 10
) -> DataFrame:
    """The fractions hold in every stratum; a numeric column is cut into quantile bins."""
    _check(test, val)

    def targets(n: Column) -> list[Column]:
        n_test = F.floor(n * F.lit(float(test)) + 0.5)
        return [n_test, n_test + F.floor((n - n_test) * F.lit(float(val) / (1.0 - float(test))) + 0.5)]

    numeric = isinstance(df.schema[column].dataType, NumericType)
    binned = quantile_bins(df, column, bins, "_stratum") if numeric else df.withColumn("_stratum", F.col(column))
    hashed = binned.withColumn("_h", seeded_hash(seed, key))
    placed = beyond_cuts(hashed, "_h", targets, ["_stratum"], "_beyond")
    return placed.withColumn("split", _named("_beyond")).drop("_h", "_beyond", "_stratum")


def split_ratio(
    df: DataFrame, key: str, train: float, val: float, test: float, stratify_by: str | None = None,
    drop: tuple[str, ...] = ("cell_mfc_name",), seed: int = 42,
) -> DataFrame:
    """Train/validation/test by ratios; the stratum column leaves the features."""
    if abs(train + val + test - 1.0) > 1e-9:
        raise ValueError("Ratios must sum to 1")
    if stratify_by is None:
        return split_random(df, key, test, val, seed).drop(*drop)
    if stratify_by not in df.columns:
        raise KeyError(stratify_by)
    if df.select(stratify_by).distinct().limit(2).count() < 2:
        raise ValueError("Need at least 2 groups to stratify by")
    return split_stratified(df, key, stratify_by, test, val, seed).drop(stratify_by)


def kfold(df: DataFrame, key: str, n: int = 5, seed: int = 42, stratum: str | None = None) -> DataFrame:
    """Adds ``fold`` 0..n-1; the first ``rows % n`` folds hold one row more."""
    def targets(total: Column) -> list[Column]:
        base, extra = F.floor(total / n), total % n
        return [base * (i + 1) + F.least(F.lit(i + 1), extra) for i in range(n - 1)]

    if n == 1:
        return df.withColumn("fold", F.lit(0))
    hashed = df.withColumn("_h", seeded_hash(seed, key))
    return beyond_cuts(hashed, "_h", targets, [stratum] if stratum else None, "fold").drop("_h")


def repeated_splits(
    df: DataFrame, key: str, runs: int, test: float = 0.2, val: float = 0.1, seed: int = 42,
    group: str | None = None,
) -> DataFrame:
    """One row per (row, run) with a fresh split per run, of rows or whole groups."""
    _check(test, val)
    run = F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")
    h = seeded_hash(F.col("run") + seed, group or key)
    if not group:
        hashed = df.select("*", run).withColumn("_h", h)
        placed = beyond_cuts(hashed, "_h", _ends(test, val), ["run"], "_beyond", few=True)
        return placed.withColumn("split", _named("_beyond")).drop("_h", "_beyond")
    units = df.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias(group)).distinct()
    hashed = units.select(group, run).withColumn("_h", h)
    # one row per run
    cuts = F.broadcast(hash_cuts(hashed, "_h", _ends(test, val), ["run"]).select("run", "cuts"))
    return df.select("*", run).join(cuts, "run").withColumn("split", _label(h, F.col("cuts"))).drop("cuts")


def split_with_roles(
    df: DataFrame, key: str, test: float = 0.2, val: float = 0.1, seed: int = 42,
    group_by: str | None = "cell_mfc_name", stratify_by: str | None = None,
) -> DataFrame:
    """The split of the training entry point: a group column overrides a stratum."""
    if group_by:
        return split_group(df, group_by, test, val, seed)
    if stratify_by:
        return split_stratified(df, key, stratify_by, test, val, seed)
    return split_random(df, key, test, val, seed)
