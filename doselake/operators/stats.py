"""Aggregates and statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doselake.functions.quantiles import array_quantiles, exact_quantiles
from doselake.schema import nan_to_null


def mean_viability(pairs: DataFrame, key: str = "sig_id") -> DataFrame:
    """Mean curve value per signature."""
    return pairs.groupBy(key).agg(
        F.avg("viability").alias("viability"), F.count("viability").alias("n_curves")
    )


def min_concentration(curves: DataFrame, measurements: DataFrame) -> DataFrame:
    """Curves with log2 of the lowest concentration measured for their pair."""
    keys = ["experiment_id", "master_cpd_id"]
    lowest = measurements.groupBy(*keys).agg(F.min("cpd_conc_umol").alias("_c"))
    return curves.join(lowest, keys, "left").withColumn(
        "lowest_conc_log2", F.when(F.col("_c") > 0, F.log2("_c"))
    ).drop("_c")


def match_summary(
    matched: DataFrame, eligible: DataFrame, compound: str = "cpd_smiles", compounds: DataFrame | None = None
) -> DataFrame:
    """Matches, distinct compounds, and the matched share of eligible signatures.

    ``matched`` holds pairs, or signatures only; then ``compounds`` holds the
    rows whose compounds are counted.
    """
    n = eligible.agg(F.countDistinct("sig_id"))
    found = matched if compounds is None else compounds
    return (
        matched.agg(F.countDistinct("sig_id").alias("n_matched"))
        .withColumn("n_compounds", found.agg(F.countDistinct(compound)).scalar())
        .withColumn("n_eligible", n.scalar())
        .withColumn("coverage", F.try_divide(F.col("n_matched"), F.col("n_eligible")))
    )


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values per column, columns without any left out."""
    cols = columns or df.columns
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}

    def missing(c: str) -> Column:
        gap = F.col(c).isNull() | (F.isnan(c) if c in numeric else F.lit(False))
        return F.sum(gap.cast("bigint")).alias(c)

    one = df.agg(*[missing(c) for c in cols])
    return one.unpivot([], cols, "column", "n_missing").where("n_missing > 0")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max per numeric column; missing ignored."""
    cells = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("values"))
    seen = array_quantiles(cells, [0.25, 0.5, 0.75]).to_pydict()
    spread = [None if not n or n < 2 else (m2 / (n - 1)) ** 0.5 for n, m2 in zip(seen["n"], seen["m2"], strict=True)]
    quartiles = [q or [None] * 3 for q in seen["q"]]
    rows = [
        (columns[pos], n, mean, std, low, *q, high)
        for pos, n, mean, std, low, q, high in zip(
            *(seen[c] for c in ("pos", "n", "mean")), spread, seen["low"], quartiles, seen["high"], strict=True
        )
    ]
    names = ("mean", "std", "min", "q25", "q50", "q75", "max")
    return df.sparkSession.createDataFrame(rows, "column string, count bigint, " + ", ".join(f"{c} double" for c in names))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency table, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.col("count").desc(), F.col(column)
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over the value range, the last one closed on the right."""
    x = df.select(nan_to_null(F.col(column).cast("double")).alias("x")).where("x IS NOT NULL")
    span = x.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")))
    flat = F.col("_s.lo") == F.col("_s.hi")

    def edges(df: DataFrame) -> DataFrame:
        return df.withColumn("_s", span.scalar()).withColumn(
            "_lo", F.when(flat, F.col("_s.lo") - 0.5).otherwise(F.col("_s.lo"))
        ).withColumn(
            "_w", F.when(flat, F.lit(1.0 / bins)).otherwise((F.col("_s.hi") - F.col("_s.lo")) / bins)
        )

    at = F.least(F.floor((F.col("x") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    counted = edges(x).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = edges(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))).select(
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left_edge"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("right_edge"),
    )
    return grid.join(counted, "bin", "left").select(
        "bin", "left_edge", "right_edge", F.coalesce("count", F.lit(0)).alias("count")
    )


def safe_pearson(y: Column, p: Column) -> Column:
    """Pearson correlation, NULL (not an error) when a side is constant."""
    return F.try_divide(F.covar_pop(y, p), F.sqrt(F.var_pop(y)) * F.sqrt(F.var_pop(p)))


def _r2(y: Column, p: Column) -> Column:
    return F.lit(1.0) - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))


Metric = Callable[[Column, Column], Column]

METRICS: dict[str, Metric] = {
    "mse": lambda y, p: F.avg((y - p) * (y - p)),
    "rmse": lambda y, p: F.sqrt(F.avg((y - p) * (y - p))),
    "mae": lambda y, p: F.avg(F.abs(y - p)),
    "r2": _r2,
    "pearson": safe_pearson,
}


def metric_columns(
    names: Iterable[str] | str = "all", target: str = "target", prediction: str = "prediction",
    extra: dict[str, Metric] | None = None,
) -> list[Column]:
    """Aggregate columns of the named metrics; ``all`` is every built-in one."""
    known = {**METRICS, **(extra or {})}
    names = [names] if isinstance(names, str) else list(names)
    if "all" in names:
        names = [*METRICS, *(extra or {})]
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"Unknown metrics: {unknown}")
    both = F.col(target).isNotNull() & F.col(prediction).isNotNull()
    y = F.when(both, F.col(target).cast("double"))
    p = F.when(both, F.col(prediction).cast("double"))
    return [known[n](y, p).alias(n) for n in names]


def regression_metrics(
    predictions: DataFrame, by: list[str] | None = None, names: Iterable[str] | str = "all",
    target: str = "target", prediction: str = "prediction", extra: dict[str, Metric] | None = None,
) -> DataFrame:
    """Metrics over all rows or per group, in one aggregation pass."""
    return predictions.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), *metric_columns(names, target, prediction, extra)
    )


def loss(predictions: DataFrame, kind: str = "mse", target: str = "target",
         prediction: str = "prediction") -> DataFrame:
    """Mean loss per sample."""
    if kind not in ("mse", "mae"):
        raise ValueError(f"Unknown loss: {kind}")
    return predictions.agg(*metric_columns(kind, target, prediction)).withColumnRenamed(kind, "loss")


def weighted_score(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("weighted_score", (F.col("r2") + F.col("pearson")) / 2)


def run_stats(metrics: DataFrame, by: list[str] | None = None, metric: str = "metric",
              value: str = "value") -> DataFrame:
    """Mean, population std, min and max of each metric over runs."""
    return metrics.groupBy(*(by or []), metric).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n_runs"),
    )


def cross_dataset_matrix(scores: DataFrame, train: str, test: str, value: str,
                         tests: list[str]) -> DataFrame:
    """Train by test grid of a metric; a missing cell is NULL."""
    return scores.groupBy(train).pivot(test, tests).agg(F.first(value))


def pivot_scores(scores: DataFrame, row: str, column: str, value: str, order: list[str]) -> DataFrame:
    """Row by column grid in a fixed column order; a repeated cell is an error."""
    twice = F.raise_error(F.lit("duplicate entries for one cell of the grid"))
    cell = F.when(F.count(value) > 1, twice.cast("double")).otherwise(F.first(value, ignorenulls=True))
    return scores.groupBy(row).pivot(column, order).agg(cell)


def mean_by_facets(scores: DataFrame, facets: list[str], value: str) -> DataFrame:
    return scores.groupBy(*facets).agg(F.avg(value).alias("mean_score"), F.count(value).alias("n"))


def box_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile ranges."""
    q = exact_quantiles(df, by, value, [0.25, 0.5, 0.75]).withColumn(
        "_iqr", F.col("q")[2] - F.col("q")[0]
    )
    x = F.col(value).cast("double")
    lo, hi = F.col("q")[0] - 1.5 * F.col("_iqr"), F.col("q")[2] + 1.5 * F.col("_iqr")
    return (
        df.join(q, by)
        .groupBy(*by)
        .agg(
            F.min(x).alias("min"), F.first(F.col("q")[0]).alias("q1"),
            F.first(F.col("q")[1]).alias("median"), F.first(F.col("q")[2]).alias("q3"),
            F.max(x).alias("max"),
            F.min(F.when(x >= lo, x)).alias("whisker_low"),
            F.max(F.when(x <= hi, x)).alias("whisker_high"),
            F.sum(((x < lo) | (x > hi)).cast("bigint")).alias("n_outliers"),
        )
    )


def distinct_triplets(df: DataFrame) -> DataFrame:
    """Number of distinct (cell, compound, dose)."""
    cols = ["cell_mfc_name", "pert_mfc_id", "pert_dose"]
    return df.select(*cols).distinct().agg(F.count(F.lit(1)).alias("n_triplets"))


def best_fit_line(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares slope, intercept and r squared."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    slope = F.try_divide(F.covar_pop(a, b), F.var_pop(a))
    r = safe_pearson(a, b)
    return df.groupBy(*(by or [])).agg(
        slope.alias("slope"), (F.avg(b) - slope * F.avg(a)).alias("intercept"), (r * r).alias("r2")
    )


def pearson_test(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """r, its t statistic, and the degrees of freedom."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    agg = df.groupBy(*(by or [])).agg(safe_pearson(a, b).alias("r"), (F.count(a) - 2).alias("df"))
    r = F.col("r")
    return agg.withColumn("t", r * F.sqrt(F.greatest(
        F.try_divide(F.col("df").cast("double"), 1 - r * r), F.lit(0.0)
    )))
