"""Regression, scoring and attribution queries.

One-feature fits have a closed form, so most can be checked in SQL.
"""

from __future__ import annotations

from functools import partial

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doselake.operators import history as W
from doselake.operators import knn
from doselake.operators import models as L
from doselake.operators import network as G
from doselake.operators import split as X
from doselake.operators import stats as A
from doselake.plans.catalog import query, r
from doselake.plans.split_queries import _parts
from doselake.plans.standins import Tables
from doselake.session import cut_lineage, scratch_path


def _rows(t: Tables) -> DataFrame:
    """The orders, stored once because a fit reads its rows several times."""
    return cut_lineage(t.order_rows)


def _terms(t: Tables, model: Model, digits: int = 4) -> DataFrame:
    rows = [("slope", float(model.coefficients[0])), ("intercept", float(model.intercept))]
    return t.spark.createDataFrame(rows, "term STRING, value DOUBLE").select("term", r("value", digits))


def _closed(slope: str, digits: int = 4) -> str:
    """Slope and intercept of a one-feature fit."""
    return f"""
WITH m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS cxy, var_pop(x) AS vx, count(*) AS n FROM order_rows),
b AS (SELECT *, {slope} AS b FROM m)
SELECT 'slope' AS term, round(b, {digits}) AS value FROM b UNION ALL SELECT 'intercept', round(my - b * mx, {digits}) FROM b"""


@query(_closed("cxy / vx"))
def fit_linear(t: Tables) -> DataFrame:
    return _terms(t, L.fit_linear(_rows(t), "y"))


@query(_closed("n * cxy / (n * vx + 100000)"))
def fit_ridge(t: Tables) -> DataFrame:
    return _terms(t, L.fit_ridge(_rows(t), "y", 100000.0))


@query(_closed("sign(cxy) * greatest(abs(cxy) - 50, 0) / vx", 3))
def fit_lasso(t: Tables) -> DataFrame:
    return _terms(t, L.fit_lasso(_rows(t), "y", 50.0), 3)


@query(_closed("sign(cxy) * greatest(abs(cxy) - 100 * 0.4::DOUBLE, 0) / (vx + 100 * 0.6::DOUBLE)", 3))
def fit_elastic_net(t: Tables) -> DataFrame:
    return _terms(t, L.fit_elastic_net(_rows(t), "y", 100.0, 0.4), 3)


@query()
def fit_bayesian_ridge(t: Tables) -> DataFrame:
    return _terms(t, L.fit_bayesian_ridge(_rows(t), "y"))


@query()
def fit_huber(t: Tables) -> DataFrame:
    return _terms(t, L.fit_huber(_rows(t), "y"), 3)


def _scored(t: Tables, fit) -> DataFrame:
    rows = cut_lineage(X.split_random(t.order_rows, "sig_id"))
    model = fit(rows.where("split = 'train'"))
    out = L.predict(model, rows.where("split = 'test'")).withColumn("target", F.col("y"))
    return A.regression_metrics(out).select("n", r("mse", 3), r("mae", 3), r("r2"), r("pearson"))


@query()
def fit_random_forest(t: Tables) -> DataFrame:
    return _scored(t, lambda d: L.fit_random_forest(d, "y", numTrees=10, maxDepth=4))


@query()
def fit_gbt(t: Tables) -> DataFrame:
    return _scored(t, lambda d: L.fit_gbt(d, "y", maxIter=5, maxDepth=3))


@query("""
WITH m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / var_pop(x) AS b FROM order_rows)
SELECT sig_id, round(my + b * (x - mx), 4) AS prediction FROM order_rows, m""")
def predict(t: Tables) -> DataFrame:
    rows = _rows(t)
    return L.predict(L.fit_linear(rows, "y"), rows).select("sig_id", r("prediction", 4))


@query("""
WITH m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / var_pop(x) AS b FROM order_rows)
SELECT sig_id, round(my + b * (x - mx), 4) AS prediction FROM order_rows, m""")
def load_model(t: Tables) -> DataFrame:
    path = L.save_model(L.fit_linear(_rows(t), "y"), scratch_path(t.spark, "model"))
    return L.predict(L.load_model(L.LinearTableModel, path), t.order_rows).select("sig_id", r("prediction", 4))


FOLDS = "f AS (SELECT x, y, ntile(5) OVER (ORDER BY md5('42:' || sig_id)) - 1 AS fold FROM order_rows)"
FOLD_SCORES = f"""
WITH {FOLDS}, k AS (SELECT unnest(range(5)) AS fold),
m AS (SELECT k.fold, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / var_pop(x) AS b FROM k JOIN f ON f.fold <> k.fold GROUP BY 1),
s AS (SELECT f.fold, 1 - avg((y - (my + b * (x - mx))) ** 2) / var_pop(y) AS r2 FROM f JOIN m USING (fold) GROUP BY 1)"""


@query(FOLD_SCORES + "SELECT round(avg(r2), 5) AS cv_mean, round(stddev_pop(r2), 5) AS cv_std FROM s")
def cv_score(t: Tables) -> DataFrame:
    return L.cv_score(t.order_rows, L.fit_linear, "y").select(r("cv_mean", 5), r("cv_std", 5))


def _grid_sql(slope: str, shares: bool = False) -> str:
    """Fold scores of one-feature fits over the whole grid of penalties."""
    columns = "alpha, l1_ratio" if shares else "alpha"
    grid = f"SELECT unnest({L.ALPHAS}::DOUBLE[]) AS alpha"
    if shares:
        grid = f"SELECT alpha, l1_ratio FROM ({grid}), (SELECT unnest({L.L1_RATIOS}::DOUBLE[]) AS l1_ratio)"
    return f"""
WITH {FOLDS}, k AS (SELECT unnest(range(5)) AS fold), g AS ({grid}),
m AS (SELECT k.fold, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS cxy, var_pop(x) AS vx, count(*) AS n
  FROM k JOIN f ON f.fold <> k.fold GROUP BY 1),
b AS (SELECT fold, mx, my, {columns}, {slope} AS b FROM m, g),
s AS (SELECT {columns}, f.fold, 1 - avg((y - (my + b * (x - mx))) ** 2) / var_pop(y) AS r2
  FROM f JOIN b USING (fold) GROUP BY {columns}, f.fold)
SELECT {columns}, round(avg(r2), 5) AS cv_mean, round(stddev_pop(r2), 5) AS cv_std FROM s GROUP BY {columns}"""


@query(_grid_sql("n * cxy / (n * vx + alpha)"))
def choose_alpha(t: Tables) -> DataFrame:
    _, scores = L.choose_alpha(t.order_rows, L.fit_ridge, "y")
    return scores.select("alpha", r("cv_mean", 5), r("cv_std", 5))


@query(_grid_sql("sign(cxy) * greatest(abs(cxy) - alpha, 0) / vx"))
def choose_alpha_lasso(t: Tables) -> DataFrame:
    _, scores = L.choose_alpha(t.order_rows, L.fit_lasso, "y")
    return scores.select("alpha", r("cv_mean", 5), r("cv_std", 5))


@query(_grid_sql("sign(cxy) * greatest(abs(cxy) - alpha * l1_ratio, 0) / (vx + alpha * (1 - l1_ratio))", shares=True))
def elastic_net_scores(t: Tables) -> DataFrame:
    scores = L.elastic_net_scores(t.order_rows, "y")
    return scores.select("alpha", "l1_ratio", r("cv_mean", 5), r("cv_std", 5))


def _pair_rows(t: Tables) -> DataFrame:
    """The orders with two features: their quantity and their cell."""
    both = F.array(F.col("x").cast("double"), F.col("cell").cast("double"))
    return t.order_rows.withColumn("values", both)


def _pair_terms(t: Tables, model: Model) -> DataFrame:
    rows = [(f"slope_{i}", float(c)) for i, c in enumerate(model.coefficients)] + [("intercept", float(model.intercept))]
    return t.spark.createDataFrame(rows, "term STRING, value DOUBLE").select("term", r("value", 4))


def _pair_sql(l1: str = "0", l2: str = "0") -> str:
    """Two features in closed form; with ``l1`` the signs are those of plain least squares."""
    return f"""
WITH m AS (SELECT count(*) AS n, avg(x) AS mx, avg(cell) AS mz, avg(y) AS my, var_pop(x) AS a, var_pop(cell) AS c,
  covar_pop(x, cell) AS b, covar_pop(x, y) AS p, covar_pop(cell, y) AS q FROM order_rows),
o AS (SELECT *, sign(c * p - b * q) * ({l1}) AS s, sign(a * q - b * p) * ({l1}) AS t, a + ({l2}) AS d, c + ({l2}) AS e FROM m),
w AS (SELECT *, (e * (p - s) - b * (q - t)) / (d * e - b * b) AS u, (d * (q - t) - b * (p - s)) / (d * e - b * b) AS v FROM o)
SELECT 'slope_0' AS term, round(u, 4) AS value FROM w UNION ALL SELECT 'slope_1', round(v, 4) FROM w
UNION ALL SELECT 'intercept', round(my - u * mx - v * mz, 4) FROM w"""


@query(_pair_sql())
def fit_linear_pair(t: Tables) -> DataFrame:
    return _pair_terms(t, L.fit_linear(_pair_rows(t), "y"))


@query(_pair_sql(l2="100000.0 / n"))
def fit_ridge_pair(t: Tables) -> DataFrame:
    return _pair_terms(t, L.fit_ridge(_pair_rows(t), "y", 100000.0))


@query(_pair_sql(l1="0.001::DOUBLE"))
def fit_lasso_pair(t: Tables) -> DataFrame:
    return _pair_terms(t, L.fit_lasso(_pair_rows(t), "y", 0.001))


@query(_pair_sql(l1="0.001::DOUBLE * 0.4::DOUBLE", l2="0.001::DOUBLE * 0.6::DOUBLE"))
def fit_elastic_net_pair(t: Tables) -> DataFrame:
    return _pair_terms(t, L.fit_elastic_net(_pair_rows(t), "y", 0.001, 0.4))


@query(_pair_sql(l2="100000.0 / n").replace("SELECT 'slope_0' AS term", "SELECT 0 AS feature").replace("SELECT 'slope_1'", "SELECT 1")
       .replace("AS value FROM w", "AS score FROM w").split("UNION ALL SELECT 'intercept'")[0], ints=("feature",))
def feature_importance_pair(t: Tables) -> DataFrame:
    rows = _pair_rows(t)
    return L.feature_importance(L.fit_ridge(rows, "y", 100000.0), rows).select("feature", r("score", 4))


def _screening_rows(t: Tables) -> DataFrame:
    """Signatures with their viability; all genes."""
    return t.matrix.join(t.rowmeta.where("viability IS NOT NULL"), "sig_id")


@query()
def fit_wide(t: Tables) -> DataFrame:
    """Coefficients of all linear models on all genes."""
    rows = cut_lineage(_screening_rows(t).select("sig_id", "values", "viability"))
    out = []
    for name, fit in LINEAR_MODELS.items():
        model = fit(rows, "viability")
        out += [(name, i, float(c)) for i, c in enumerate(model.coefficients)] + [(name, -1, float(model.intercept))]
    return t.spark.createDataFrame(out, "model STRING, feature INT, coef DOUBLE").select("model", "feature", r("coef", 4))


LINEAR_MODELS = {
    "linear": L.fit_linear, "ridge": partial(L.fit_ridge, alpha=1.0), "lasso": partial(L.fit_lasso, alpha=0.01),
    "elastic_net": partial(L.fit_elastic_net, alpha=0.01, l1_ratio=0.4), "bayesian_ridge": L.fit_bayesian_ridge, "huber": L.fit_huber,
}


@query()
def model_table(t: Tables) -> DataFrame:
    """All linear models on genes and on factor activity, with five folds."""
    rows = cut_lineage(X.split_random(_screening_rows(t), "sig_id"))
    activity = G.tf_activity_ulm(rows, t.genes, t.network, metadata=("viability", "split"))
    by_name = F.array_sort(F.collect_list(F.struct("source", "activity")))
    factors = activity.groupBy("sig_id", "viability", "split").agg(by_name.alias("a"))
    factors = cut_lineage(factors.select("sig_id", "viability", "split", F.transform("a", lambda c: c["activity"]).alias("values")))
    sets = {"genes": rows.select("sig_id", "viability", "split", "values"), "tf_activity": factors}
    data = {name: (d.where("split = 'train'"), d.where("split = 'test'")) for name, d in sets.items()}
    table = L.model_table(data, LINEAR_MODELS, "viability", folds=5)
    return table.select("feature_set", "model", *[r(c, 4) for c in table.columns[2:]])


@query(f"""
WITH p AS (SELECT run, x, y, {_parts('n')} FROM (
  SELECT x, y, run, row_number() OVER (PARTITION BY run ORDER BY md5((42 + run) || ':' || sig_id)) AS rn,
    count(*) OVER (PARTITION BY run) AS n FROM order_rows, (SELECT unnest(range(20)) AS run))),
m AS (SELECT run, avg(x) AS mx, avg(y) AS my, count(*) * covar_pop(x, y) / (count(*) * var_pop(x) + 1) AS b
  FROM p WHERE split = 'train' GROUP BY run)
SELECT run, split, round(1 - avg((y - (my + b * (x - mx))) ** 2) / var_pop(y), 5) AS r2,
  round(corr(y, my + b * (x - mx)), 5) AS pearson FROM p JOIN m USING (run) GROUP BY run, split""", ints=("run",))
def repeat_fit(t: Tables) -> DataFrame:
    scores = L.repeat_fit(t.order_rows, L.fit_ridge, "y", 20)
    return scores.select("run", "split", r("r2", 5), r("pearson", 5))


@query(f"""
WITH c AS (SELECT run, cell, row_number() OVER (PARTITION BY run ORDER BY md5((42 + run) || ':' || cell)) AS rn,
    count(*) OVER (PARTITION BY run) AS n FROM (SELECT DISTINCT cell FROM order_rows), (SELECT unnest(range(20)) AS run)),
g AS (SELECT run, cell, {_parts('n')} FROM c),
p AS (SELECT g.run, g.split, x, y FROM order_rows JOIN g USING (cell)),
m AS (SELECT run, avg(x) AS mx, avg(y) AS my, count(*) * covar_pop(x, y) / (count(*) * var_pop(x) + 1) AS b
  FROM p WHERE split = 'train' GROUP BY run),
s AS (SELECT run, split, 1 - avg((y - (my + b * (x - mx))) ** 2) / var_pop(y) AS r2,
  corr(y, my + b * (x - mx)) AS pearson FROM p JOIN m USING (run) GROUP BY run, split),
l AS (SELECT split, metric, value FROM s UNPIVOT (value FOR metric IN (r2, pearson)))
SELECT split, metric, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std FROM l GROUP BY split, metric""")
def repeat_summary(t: Tables) -> DataFrame:
    scores = L.repeat_fit(t.order_rows, L.fit_ridge, "y", 20, group="cell")
    return L.repeat_summary(scores).select("split", "metric", r("mean", 5), r("std", 5))


def _coef(t: Tables) -> DataFrame:
    return t.genes.select("pos", ((F.col("pos") % 5 - 2) / 10.0).alias("coef"))


COEF = "c AS (SELECT pos, CAST(pos % 5 - 2 AS DOUBLE) / 10 AS coef FROM genes)"


def _table_model(t: Tables, shift: float = 0.0) -> L.LinearTableModel:
    return L.LinearTableModel([(p % 5 - 2) / 10.0 for p in range(64)], shift)


@query(f"""
WITH {COEF} SELECT pos AS feature, round(avg(abs(x * coef)), 6) AS score FROM expr JOIN c USING (pos) GROUP BY 1
ORDER BY avg(abs(x * coef)) DESC LIMIT 10""")
def linear_attribution(t: Tables) -> DataFrame:
    scores = L.mean_attribution(L.linear_attribution(t.matrix, _coef(t)))
    return W.top_features(scores, 10).select("feature", r("score"))


@query(f"""
WITH {COEF}, p AS (SELECT CASE WHEN pos < 40 THEN 'transcriptomics' WHEN pos < 60 THEN 'molecular' ELSE 'dosage' END AS modality,
  avg(abs(x * coef)) AS importance FROM expr JOIN c USING (pos) GROUP BY 1)
SELECT modality, round(importance, 6) AS importance, round(importance / (SELECT sum(importance) FROM p) * 100, 5) AS percent FROM p""")
def modality_importance(t: Tables) -> DataFrame:
    ranges = {"transcriptomics": (0, 40), "molecular": (40, 60), "dosage": (60, 64)}
    m = L.modality_importance(L.linear_attribution(t.matrix, _coef(t)), ranges)
    return m.select("modality", r("importance"), r("percent", 5))


@query(f"WITH {COEF} SELECT sig_id, pos AS feature, round(x * coef, 6) AS attribution FROM expr JOIN c USING (pos) WHERE pos IN (0, 6, 13)")
def feature_ablation(t: Tables) -> DataFrame:
    return L.feature_ablation(_table_model(t, 0.5), t.matrix, [0, 6, 13]).select("sig_id", "feature", r("attribution"))


@query()
def feature_importance(t: Tables) -> DataFrame:
    rows = t.matrix.join(t.rowmeta.where("viability IS NOT NULL"), "sig_id")
    model = L.fit_ridge(rows, "viability", 1.0)
    return W.top_features(L.feature_importance(model, rows), 10).select("feature", r("score"))


@query(f"""
WITH {COEF}, p AS (SELECT sig_id, sum(x * coef) AS z FROM expr JOIN c USING (pos) GROUP BY 1),
q AS (SELECT run, viability AS y, z + shift AS p FROM p JOIN rowmeta USING (sig_id),
  (SELECT 'a' AS run, 0.25::DOUBLE AS shift UNION ALL SELECT 'b', 0.5::DOUBLE) WHERE viability IS NOT NULL)
SELECT run, count(*) AS n, round(avg((y - p) ** 2), 6) AS mse, round(avg(abs(y - p)), 6) AS mae,
  round(1 - avg((y - p) ** 2) / var_pop(y), 5) AS r2, round(corr(y, p), 5) AS pearson FROM q GROUP BY run""")
def evaluate_runs(t: Tables) -> DataFrame:
    rows = t.matrix.join(t.rowmeta.where("viability IS NOT NULL"), "sig_id")
    per_run, _ = L.evaluate_runs({"a": _table_model(t, 0.25), "b": _table_model(t, 0.5)}, rows, "viability")
    return per_run.select("run", "n", r("mse"), r("mae"), r("r2", 5), r("pearson", 5))


KNN = """
WITH d AS (SELECT a.sig_id, b.sig_id AS other, sqrt(sum((a.x - b.x) ** 2)) AS dist
  FROM expr a JOIN expr b ON a.pos = b.pos
  WHERE a.sig_id IN (SELECT vec_id FROM embeddings WHERE label = 0)
    AND b.sig_id IN (SELECT vec_id FROM embeddings WHERE label <> 0) GROUP BY 1, 2),
k AS (SELECT sig_id, dist, CAST(other % 101 AS DOUBLE) AS y, row_number() OVER (PARTITION BY sig_id ORDER BY dist, other) AS rn FROM d)
"""


def _knn(t: Tables, weights: str) -> DataFrame:
    rows = t.matrix.join(t.raw("embeddings").select(F.col("vec_id").alias("sig_id"), "label"), "sig_id")
    train = rows.where("label <> 0").withColumn("target", F.col("sig_id") % 101)
    return knn.knn_regress(train, rows.where("label = 0"), 5, weights, block=200).select("sig_id", r("prediction"))


@query(KNN + "SELECT sig_id, round(avg(y), 6) AS prediction FROM k WHERE rn <= 5 GROUP BY sig_id")
def knn_regress(t: Tables) -> DataFrame:
    return _knn(t, "uniform")


@query(KNN + """
SELECT sig_id, round(coalesce(avg(CASE WHEN dist = 0 THEN y END), sum(CASE WHEN dist > 0 THEN y / dist END)
  / sum(CASE WHEN dist > 0 THEN 1 / dist END)), 6) AS prediction FROM k WHERE rn <= 5 GROUP BY sig_id""")
def knn_regress_weighted(t: Tables) -> DataFrame:
    return _knn(t, "distance")
