"""Baseline regressors, scoring, ensembles, and attributions."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
from pyspark.ml import Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doselake.operators.linear import (
    Evidence, LinearTableModel, Penalty, cross_sums, fit_evidence, fit_penalty, fold_scores, product_scores,
)
from doselake.operators.matrix import exploded, per_gene_array, with_arrays
from doselake.operators.split import kfold, repeated_splits, split_group, split_random
from doselake.operators.stats import metric_columns, regression_metrics, run_stats, weighted_score
from doselake.session import cut_lineage

# The search spaces of the baseline study. Spark has no minimum
# number of rows to split a node, so that one is left out.
ALPHAS = [0.01, 0.1, 1.0, 10.0]
L1_RATIOS = [0.2, 0.4, 0.6, 0.8]
FOREST_GRID = {"numTrees": range(50, 200), "maxDepth": range(5, 20), "minInstancesPerNode": range(1, 10)}
BOOST_GRID = {
    "maxIter": range(50, 200), "stepSize": [round(0.01 * i, 2) for i in range(1, 22)],
    "maxDepth": range(3, 15), "minInstancesPerNode": range(1, 10),
}

Fit = Callable[[DataFrame, str], Model]


def with_vector(df: DataFrame, values: str = "values") -> DataFrame:
    """Adds the ``features`` vector Spark ML reads."""
    return df.withColumn("features", array_to_vector(F.col(values).cast("array<double>")))


def _linear(df: DataFrame, values: str, target: str, reg: float, l1_share: float, **kw) -> Model:
    lr = LinearRegression(
        featuresCol="features", labelCol=target, regParam=reg, elasticNetParam=l1_share,
        standardization=False, **kw,
    )
    return lr.fit(with_vector(df.select(values, F.col(target).cast("double").alias(target)), values))


def fit_linear(df: DataFrame, target: str, values: str = "values") -> LinearTableModel:
    """Ordinary least squares; the shortest coefficients where features depend on each other."""
    return fit_penalty(df, target, penalty_of(fit_linear), values)


def fit_penalised(df: DataFrame, target: str, l1: float, l2: float, values: str = "values") -> LinearTableModel:
    """Squared error per ``2n`` plus ``l1 |w|`` plus ``l2/2 |w|^2``, raw feature scale."""
    return fit_penalty(df, target, lambda n: (l1, l2), values)


def fit_ridge(df: DataFrame, target: str, alpha: float = 1.0, values: str = "values") -> LinearTableModel:
    """Summed squared error plus ``alpha |w|^2``."""
    return fit_penalty(df, target, penalty_of(fit_ridge, alpha), values)


def fit_lasso(df: DataFrame, target: str, alpha: float = 1.0, values: str = "values") -> LinearTableModel:
    return fit_penalty(df, target, penalty_of(fit_lasso, alpha), values)


def fit_elastic_net(
    df: DataFrame, target: str, alpha: float = 1.0, l1_ratio: float = 0.5, values: str = "values"
) -> LinearTableModel:
    return fit_penalty(df, target, penalty_of(fit_elastic_net, alpha, l1_ratio), values)


def penalty_of(fit: Fit, alpha: float = 1.0, l1_ratio: float = 0.5) -> Penalty | None:
    """``l1, l2`` by the number of rows, for the fits that have such a form; None for any other."""
    if isinstance(fit, partial) and not fit.args and set(fit.keywords) <= {"alpha", "l1_ratio"}:
        return penalty_of(fit.func, **fit.keywords)
    forms = {
        fit_linear: lambda n: (0.0, 0.0), fit_ridge: lambda n: (0.0, alpha / n), fit_lasso: lambda n: (alpha, 0.0),
        fit_elastic_net: lambda n: (alpha * l1_ratio, alpha * (1 - l1_ratio)),
    }
    return forms.get(fit)


def fit_huber(
    df: DataFrame, target: str, epsilon: float = 1.35, alpha: float = 1e-4, values: str = "values"
) -> Model:
    return _linear(df, values, target, alpha, 0.0, loss="huber", epsilon=epsilon, maxIter=200)


def fit_bayesian_ridge(
    df: DataFrame, target: str, values: str = "values", max_iter: int = 300, tol: float = 1e-3
) -> LinearTableModel:
    """Ridge whose noise and weight precisions maximise the evidence."""
    return fit_evidence(df, target, values, Evidence(max_iter, tol))


def random_grid(grid: dict[str, Sequence], n_iter: int, seed: int = 42) -> list[dict]:
    """Distinct seeded draws from a parameter grid."""
    size = int(np.prod([len(v) for v in grid.values()]))
    picks = random.Random(seed).sample(range(size), min(n_iter, size))
    out = []
    for code in picks:
        combo = {}
        for name, options in grid.items():
            code, at = divmod(code, len(options))
            combo[name] = options[at]
        out.append(combo)
    return out


def _search(df: DataFrame, estimator, combos: list[dict], key: str, values: str, target: str, folds: int, seed: int) -> Model:
    rows = df.select(key, values, F.col(target).cast("double").alias(target))
    data = with_vector(cut_lineage(kfold(rows, key, folds, seed)), values)
    maps = [{estimator.getParam(n): v for n, v in c.items()} for c in combos]
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, numFolds=folds, foldCol="fold", seed=seed,
        evaluator=RegressionEvaluator(labelCol=target, metricName="r2"),
    )
    return cv.fit(data).bestModel


def fit_random_forest(
    df: DataFrame, target: str, key: str = "sig_id", values: str = "values", n_iter: int = 0,
    folds: int = 2, seed: int = 42, **params,
) -> Model:
    """Random forest; ``n_iter > 0`` searches that many seeded grid points first."""
    est = RandomForestRegressor(featuresCol="features", labelCol=target, seed=seed, **params)
    if n_iter:
        return _search(df, est, random_grid(FOREST_GRID, n_iter, seed), key, values, target, folds, seed)
    return est.fit(with_vector(df, values))


def fit_gbt(
    df: DataFrame, target: str, key: str = "sig_id", values: str = "values", n_iter: int = 0,
    folds: int = 2, seed: int = 42, **params,
) -> Model:
    est = GBTRegressor(featuresCol="features", labelCol=target, seed=seed, **params)
    if n_iter:
        return _search(df, est, random_grid(BOOST_GRID, n_iter, seed), key, values, target, folds, seed)
    return est.fit(with_vector(df, values))


def predict(model: Model, df: DataFrame, values: str = "values") -> DataFrame:
    """Batch scoring: adds ``prediction``."""
    if isinstance(model, LinearTableModel):
        return model.transform(df)
    return model.transform(with_vector(df, values)).drop("features")


def cv_predictions(
    df: DataFrame, fit: Fit, target: str, key: str = "sig_id", values: str = "values", folds: int = 5,
    seed: int = 42, stratum: str | None = None,
) -> DataFrame:
    """Held-out predictions ``(fold, key, target, prediction)`` of every fold."""
    cols = [key, values, target] + ([stratum] if stratum else [])
    # every fold reads these rows again for its fit and its scores
    data = cut_lineage(kfold(df.select(*dict.fromkeys(cols)), key, folds, seed, stratum))
    parts = []
    for f in range(folds):
        model = fit(data.where(F.col("fold") != f), target)
        scored = predict(model, data.where(F.col("fold") == f), values)
        parts.append(scored.select("fold", key, F.col(target).alias("target"), "prediction"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_score(
    df: DataFrame, fit: Fit, target: str, key: str = "sig_id", values: str = "values", folds: int = 5,
    seed: int = 42, metric: str = "r2",
) -> DataFrame:
    """One row: mean and population std of a metric over the folds.

    Fits with a penalty form and metrics that follow from products need no
    predictions; for others every fold is fitted and scored on its rows.
    """
    form = Evidence() if fit is fit_bayesian_ridge else penalty_of(fit)
    sums = None
    if form is not None and metric in ("r2", "pearson", "weighted_score"):
        dealt = kfold(df.select(*dict.fromkeys([key, values, target])), key, folds, seed)
        sums = cross_sums(dealt, target, values, "fold", folds)
    if sums is not None and (penalty_of(fit) or sums.strips == 1):
        per = fold_scores(sums, [form], df)
        per = weighted_score(per) if metric == "weighted_score" else per
        return per.agg(F.avg(metric).alias("cv_mean"), F.stddev_pop(metric).alias("cv_std"))
    held = cv_predictions(df, fit, target, key, values, folds, seed)
    if metric == "weighted_score":
        per = weighted_score(regression_metrics(held, ["fold"], ["r2", "pearson"]))
    else:
        per = regression_metrics(held, ["fold"], [metric])
    return per.agg(F.avg(metric).alias("cv_mean"), F.stddev_pop(metric).alias("cv_std"))


def cv_grid(
    df: DataFrame, fits: Sequence[Fit], target: str, key: str = "sig_id", values: str = "values", folds: int = 5,
    seed: int = 42,
) -> DataFrame:
    """``candidate`` (position in ``fits``), ``cv_mean`` and ``cv_std`` of R2 for many fits on the same folds.

    Penalties share one set of products. For other fits rows are dealt to folds
    and stored once; each fold's held-out rows are scored by all in one pass.
    """
    penalties = [penalty_of(fit) for fit in fits]
    if all(p is not None for p in penalties):
        dealt = kfold(df.select(*dict.fromkeys([key, values, target])), key, folds, seed)
        per = fold_scores(cross_sums(dealt, target, values, "fold", folds), penalties, df)
        return per.groupBy("candidate").agg(F.avg("r2").alias("cv_mean"), F.stddev_pop("r2").alias("cv_std"))
    data = cut_lineage(kfold(df.select(*dict.fromkeys([key, values, target])), key, folds, seed))
    out = None
    for f in range(folds):
        train, held = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
        scored = []
        for i, fit in enumerate(fits):
            held = predict(fit(train, target), held, values).withColumnRenamed("prediction", f"_p{i}")
            scored.append(F.struct(F.lit(i).alias("candidate"), F.col(f"_p{i}").alias("prediction")))
        part = held.select("fold", F.col(target).alias("target"), F.inline(F.array(*scored)))
        out = part if out is None else out.unionByName(part)
    per = regression_metrics(out, ["candidate", "fold"], ["r2"])
    return per.groupBy("candidate").agg(F.avg("r2").alias("cv_mean"), F.stddev_pop("r2").alias("cv_std"))


def choose_alpha(
    df: DataFrame, fit: Callable[[DataFrame, str, float], Model], target: str, alphas: list[float] | None = None,
    key: str = "sig_id", values: str = "values", folds: int = 5, seed: int = 42,
) -> tuple[float, DataFrame]:
    """Penalty of best mean R2 over the folds, and the score of every candidate."""
    alphas = alphas or ALPHAS
    fits = [partial(fit, alpha=a) if penalty_of(fit) else lambda d, t, a=a: fit(d, t, a) for a in alphas]
    found = cv_grid(df, fits, target, key, values, folds, seed)
    of = F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("candidate") + 1)
    scores = cut_lineage(found.select(of.alias("alpha"), "cv_mean", "cv_std"))
    best = scores.orderBy(F.col("cv_mean").desc_nulls_last(), "alpha").first()
    return best["alpha"], scores


def elastic_net_scores(
    df: DataFrame, target: str, key: str = "sig_id", values: str = "values", folds: int = 5, seed: int = 42
) -> DataFrame:
    """``alpha, l1_ratio, cv_mean, cv_std`` of every penalty and L1 share."""
    grid = [(a, share) for share in L1_RATIOS for a in ALPHAS]
    fits = [partial(fit_elastic_net, alpha=a, l1_ratio=s) for a, s in grid]
    found = cv_grid(df, fits, target, key, values, folds, seed)
    options = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(s).alias("l1_ratio")) for a, s in grid])
    of = F.element_at(options, F.col("candidate") + 1)
    return cut_lineage(found.select(of["alpha"].alias("alpha"), of["l1_ratio"].alias("l1_ratio"), "cv_mean", "cv_std"))


def choose_elastic_net(
    df: DataFrame, target: str, key: str = "sig_id", values: str = "values", folds: int = 5, seed: int = 42
) -> tuple[tuple[float, float], Model]:
    """Penalty and L1 share of best mean R2, and the model refitted on all rows."""
    scores = elastic_net_scores(df, target, key, values, folds, seed)
    best = scores.orderBy(F.col("cv_mean").desc_nulls_last(), "l1_ratio", "alpha").first()
    choice = (best["alpha"], best["l1_ratio"])
    return choice, fit_elastic_net(df, target, *choice, values)


def model_table(
    data: dict[str, tuple[DataFrame, DataFrame]], fits: dict[str, Fit], target: str, key: str = "sig_id",
    values: str = "values", folds: int = 5, seed: int = 42,
) -> DataFrame:
    """One row per (feature set, model): test metrics, weighted score, CV mean and std."""
    out = None
    for feature_set, (train, test) in data.items():
        train, test = cut_lineage(train), cut_lineage(test)
        for name, fit in fits.items():
            scored = predict(fit(train, target), test, values).withColumn("target", F.col(target))
            cv = cv_score(train, fit, target, key, values, folds, seed, "weighted_score")
            row = weighted_score(regression_metrics(scored)).withColumn(
                "_cv", cv.select(F.struct("cv_mean", "cv_std")).scalar()
            ).select(
                F.lit(feature_set).alias("feature_set"), F.lit(name).alias("model"), "mse", "mae", "r2",
                "pearson", "weighted_score", "_cv.cv_mean", "_cv.cv_std",
            )
            out = row if out is None else out.unionByName(row)
    return out


def repeat_fit(
    df: DataFrame, fit: Fit, target: str, runs: int, key: str = "sig_id", values: str = "values",
    group: str | None = None, test: float = 0.2, val: float = 0.1, seed: int = 42,
) -> DataFrame:
    """R2 and Pearson per run and part, over fresh random or group splits.

    Fits with a penalty form share one pass: the products of each run's parts
    give its fit and its scores.
    """
    cols = dict.fromkeys([key, values, target] + ([group] if group else []))
    penalty = penalty_of(fit)
    if penalty is not None:
        parts = ["train", "val", "test"]
        # the cuts and the sums read the rows, which are stored so that what made them runs once
        dealt = repeated_splits(cut_lineage(df.select(*cols)), key, runs, test, val, seed, group)
        place = F.array_position(F.array(*map(F.lit, parts)), F.col("split")) - 1
        sums = cross_sums(dealt.withColumn("part", F.col("run") * 3 + place), target, values, "part", 3 * runs)
        groups = [([3 * r], [f for f in range(3 * r, 3 * r + 3) if sums.n[f]]) for r in range(runs)]
        per = product_scores(sums, [penalty], groups, df)
        name = F.element_at(F.array(*map(F.lit, parts)), F.col("fold") % 3 + 1)
        return per.select(F.col("group").alias("run"), name.alias("split"), "r2", "pearson")
    data = cut_lineage(df.select(*cols))  # read again by every run
    out = None
    for r in range(runs):
        one = split_group(data, group, test, val, seed + r) if group else split_random(data, key, test, val, seed + r)
        found = predict(fit(one.where("split = 'train'"), target), one, values)
        part = found.select(F.lit(r).alias("run"), "split", F.col(target).alias("target"), "prediction")
        out = part if out is None else out.unionByName(part)
    return regression_metrics(out, ["run", "split"], ["r2", "pearson"])


def repeat_summary(scores: DataFrame) -> DataFrame:
    """Mean and population std over runs of each part's metrics."""
    long = scores.unpivot(["run", "split"], ["r2", "pearson"], "metric", "value")
    return run_stats(long, ["split"])


def feature_importance(model: Model, df: DataFrame) -> DataFrame:
    """``feature, score``: signed coefficients, or tree importances."""
    scores = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
    dense = scores.toArray() if hasattr(scores, "toArray") else np.asarray(scores)
    return df.sparkSession.createDataFrame(
        [(i, float(s)) for i, s in enumerate(dense)], "feature INT, score DOUBLE"
    )


def ensemble_mean_std(predictions: DataFrame, key: str = "sig_id", member: str = "member") -> DataFrame:
    """Mean and population std over members; std only with more than one member."""
    return predictions.groupBy(key).agg(
        F.avg("prediction").alias("prediction"),
        F.when(F.count("prediction") > 1, F.stddev_pop("prediction")).alias("std"),
        F.count("prediction").alias("n_members"),
    )


def linear_attribution(matrix: DataFrame, coef: list[float] | DataFrame, values: str = "values") -> DataFrame:
    """Adds ``attribution``: the share of each feature in a linear prediction.

    For a linear model this is the integrated gradient against a zero baseline.
    ``coef`` is a list or a table ``(pos, coef)``.
    """
    if isinstance(coef, DataFrame):
        with_w = matrix.withColumn("_w", per_gene_array(coef, F.col("coef")).scalar())
    else:
        with_w = with_arrays(matrix, _w=coef)
    parts = F.zip_with(F.col(values), "_w", lambda x, w: x.cast("double") * w)
    return with_w.withColumn("attribution", parts).drop("_w")


def mean_attribution(attributed: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature."""
    long = exploded(attributed, [], "attribution")
    return long.groupBy(F.col("pos").alias("feature")).agg(F.avg(F.abs("x")).alias("score"))


def modality_importance(attributed: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Mean absolute attribution per modality range ``[start, end)``, as share of the sum."""
    per_pos = exploded(attributed, [], "attribution").groupBy("pos").agg(
        F.sum(F.abs("x")).alias("s"), F.count("x").alias("n")
    )
    spans = F.array(*[
        F.struct(F.lit(m).alias("modality"), F.lit(a).alias("lo"), F.lit(b).alias("hi"))
        for m, (a, b) in ranges.items()
    ])
    inside = F.filter(spans, lambda r: (F.col("pos") >= r["lo"]) & (F.col("pos") < r["hi"]))
    table = per_pos.select("s", "n", F.explode(inside).alias("r")).groupBy(
        F.col("r.modality").alias("modality")
    ).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("importance"))
    total = table.agg(F.sum("importance"))
    return table.withColumn("percent", F.try_divide(F.col("importance"), total.scalar()) * 100)


def feature_ablation(
    model: Model, df: DataFrame, features: list[int], key: str = "sig_id", values: str = "values"
) -> DataFrame:
    """Change of the prediction when one feature is set to 0, per (key, feature)."""
    base = predict(model, df.select(key, values), values).withColumnRenamed("prediction", "_base")
    rows = base.withColumn("feature", F.explode(F.lit(features))).withColumn(
        values, F.transform(values, lambda x, i: F.when(i == F.col("feature"), F.lit(0.0)).otherwise(x.cast("double")))
    )
    return predict(model, rows, values).select(
        key, "feature", (F.col("_base") - F.col("prediction")).alias("attribution")
    )


def evaluate_runs(
    models: dict[str, Model], test: DataFrame, target: str, values: str = "values"
) -> tuple[DataFrame, DataFrame]:
    """Metrics of every model on one test set, and their statistics over models."""
    scored = None
    for run, model in models.items():
        p = predict(model, test, values).select(
            F.lit(run).alias("run"), F.col(target).alias("target"), "prediction"
        )
        scored = p if scored is None else scored.unionByName(p)
    per_run = regression_metrics(scored, ["run"])
    long = per_run.unpivot(["run"], ["mse", "rmse", "mae", "r2", "pearson"], "metric", "value")
    return per_run, run_stats(long)


def metrics_by_dataset(predictions: DataFrame, dataset: str = "dataset") -> DataFrame:
    return predictions.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"), *metric_columns())


def save_model(model: Model, path: str) -> str:
    """A new path per model; an existing one is refused by Spark."""
    model.save(path)
    return path


def load_model(kind: type, path: str) -> Model:
    return kind.load(path)
