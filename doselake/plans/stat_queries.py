"""Aggregates, statistics, and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doselake.operators import history as W
from doselake.operators import models as L
from doselake.operators import stats as A
from doselake.plans.catalog import query, r
from doselake.plans.standins import Tables

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# Metrics of one group in SQL; NULL where a side is constant.
METRIC_SQL = """count(*) AS n, round(avg((target - prediction) ** 2), 2) AS mse,
  round(sqrt(avg((target - prediction) ** 2)), 4) AS rmse, round(avg(abs(target - prediction)), 4) AS mae,
  round(1 - avg((target - prediction) ** 2) / nullif(var_pop(target), 0), 6) AS r2,
  round(covar_pop(target, prediction) / nullif(sqrt(var_pop(target)) * sqrt(var_pop(prediction)), 0), 6) AS pearson"""


def _metrics(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", r("mse", 2), r("rmse", 4), r("mae", 4), r("r2"), r("pearson"))


@query("""
SELECT "column", n_missing FROM (
  SELECT 'pert_dose' AS "column", count(*) - count(pert_dose) AS n_missing FROM rowmeta
  UNION ALL SELECT 'viability', count(*) - count(viability) FROM rowmeta
  UNION ALL SELECT 'cell_mfc_name', count(*) - count(cell_mfc_name) FROM rowmeta) WHERE n_missing > 0""")
def null_counts(t: Tables) -> DataFrame:
    return A.null_counts(t.rowmeta)


@query(" UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
 min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
 round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM lineitem""" for c in NUMBERS))
def describe(t: Tables) -> DataFrame:
    d = A.describe(t.raw("lineitem"), NUMBERS)
    return d.select("column", "count", r("mean", 4), r("std", 4), "min", r("q25"), r("q50"), r("q75"), "max")


@query("SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY 1")
def value_counts(t: Tables) -> DataFrame:
    return A.value_counts(t.raw("lineitem"), "l_suppkey")


@query("""
WITH s AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events),
c AS (SELECT CAST(least(floor((value - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM events, s GROUP BY 1)
SELECT b.bin, round(lo + b.bin * w, 6) AS left_edge, round(lo + (b.bin + 1) * w, 6) AS right_edge, coalesce(c.n, 0) AS count
FROM (SELECT CAST(unnest(range(30)) AS INTEGER) AS bin) b CROSS JOIN s LEFT JOIN c ON c.bin = b.bin""")
def histogram(t: Tables) -> DataFrame:
    return A.histogram(t.raw("events"), "value").select("bin", r("left_edge"), r("right_edge"), "count")


@query(f"SELECT {METRIC_SQL} FROM predictions")
def regression_metrics(t: Tables) -> DataFrame:
    return _metrics(A.regression_metrics(t.predictions))


@query("""
SELECT round(avg((target - prediction) ** 2), 2) AS loss, 'mse' AS kind FROM predictions
UNION ALL SELECT round(avg(abs(target - prediction)), 2), 'mae' FROM predictions""")
def loss(t: Tables) -> DataFrame:
    both = [A.loss(t.predictions, k).select(r("loss", 2)).withColumn("kind", F.lit(k)) for k in ("mse", "mae")]
    return both[0].unionByName(both[1])


@query(f"SELECT grp, round((r2 + pearson) / 2, 5) AS weighted_score FROM (SELECT grp, {METRIC_SQL} FROM predictions GROUP BY grp)")
def weighted_score(t: Tables) -> DataFrame:
    m = A.weighted_score(A.regression_metrics(t.predictions, ["grp"]).withColumns(
        {"r2": r(F.col("r2")), "pearson": r(F.col("pearson"))}))
    return m.select("grp", r("weighted_score", 5))


@query("SELECT count(*) AS n, round(avg(abs(target - prediction) / nullif(target, 0)), 6) AS mape, round(avg(abs(target - prediction)), 4) AS mae FROM predictions")
def custom_metric(t: Tables) -> DataFrame:
    mape = {"mape": lambda y, p: F.avg(F.try_divide(F.abs(y - p), y))}
    return A.regression_metrics(t.predictions, names=["mape", "mae"], extra=mape).select("n", r("mape"), r("mae", 4))


@query(f"SELECT grp, {METRIC_SQL} FROM predictions GROUP BY grp")
def metrics_by_group(t: Tables) -> DataFrame:
    return _metrics(A.regression_metrics(t.predictions, ["grp"]), "grp")


@query(f"SELECT dataset, {METRIC_SQL} FROM predictions GROUP BY dataset")
def metrics_by_dataset(t: Tables) -> DataFrame:
    return _metrics(L.metrics_by_dataset(t.predictions), "dataset")


@query(f"""
SELECT metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min,
  round(max(value), 4) AS max, count(*) AS n_runs
FROM (SELECT run, {METRIC_SQL} FROM predictions GROUP BY run) UNPIVOT (value FOR metric IN (rmse, mae, r2, pearson))
GROUP BY metric""")
def run_stats(t: Tables) -> DataFrame:
    per = _metrics(A.regression_metrics(t.predictions, ["run"]), "run")
    long = per.unpivot(["run"], ["rmse", "mae", "r2", "pearson"], "metric", "value")
    s = A.run_stats(long)
    return s.select("metric", r("mean", 4), r("std", 4), r("min", 4), r("max", 4), "n_runs")


@query("""
SELECT grp AS train, round(avg(CASE WHEN dataset = 'O' THEN abs(target - prediction) END), 4) AS "O",
  round(avg(CASE WHEN dataset = 'F' THEN abs(target - prediction) END), 4) AS "F",
  CAST(NULL AS DOUBLE) AS "X" FROM predictions GROUP BY grp""")
def cross_dataset_matrix(t: Tables) -> DataFrame:
    scores = A.regression_metrics(t.predictions, ["grp", "dataset"], ["mae"]).withColumnRenamed("grp", "train")
    grid = A.cross_dataset_matrix(scores, "train", "dataset", "mae", ["O", "F", "X"])
    return grid.select("train", r("O", 4), r("F", 4), r("X", 4))


@query("""
SELECT run AS feature_set, round(avg(CASE WHEN grp = 'A' THEN abs(target - prediction) END), 4) AS "A",
  round(avg(CASE WHEN grp = 'N' THEN abs(target - prediction) END), 4) AS "N",
  round(avg(CASE WHEN grp = 'R' THEN abs(target - prediction) END), 4) AS "R" FROM predictions GROUP BY run""")
def pivot_scores(t: Tables) -> DataFrame:
    scores = A.regression_metrics(t.predictions, ["run", "grp"], ["mae"]).withColumnRenamed("run", "feature_set")
    return A.pivot_scores(scores, "feature_set", "grp", "mae", ["A", "N", "R"]).select(
        "feature_set", r("A", 4), r("N", 4), r("R", 4))


@query("SELECT grp, dataset, round(avg(target), 3) AS mean_score, count(target) AS n FROM predictions GROUP BY grp, dataset")
def mean_by_facets(t: Tables) -> DataFrame:
    return A.mean_by_facets(t.predictions, ["grp", "dataset"], "target").select("grp", "dataset", r("mean_score", 3), "n")


@query("""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3
           FROM events GROUP BY 1)
SELECT e.event_type, min(value) AS min, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median,
  round(any_value(q3), 6) AS q3, max(value) AS max,
  min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END) AS whisker_low,
  max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_high,
  CAST(sum(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers
FROM events e JOIN q USING (event_type) GROUP BY 1""")
def box_summary(t: Tables) -> DataFrame:
    b = A.box_summary(t.raw("events"), ["event_type"], "value")
    return b.select("event_type", "min", r("q1"), r("median"), r("q3"), "max", "whisker_low", "whisker_high", "n_outliers")


@query("SELECT count(*) AS n_triplets FROM (SELECT DISTINCT cell_mfc_name, pert_mfc_id, pert_dose FROM siginfo)")
def distinct_triplets(t: Tables) -> DataFrame:
    return A.distinct_triplets(t.siginfo)


@query("""
SELECT grp, round(regr_slope(target, prediction), 6) AS slope, round(regr_intercept(target, prediction), 3) AS intercept,
  round(corr(target, prediction) ** 2, 6) AS r2 FROM predictions GROUP BY grp""")
def best_fit_line(t: Tables) -> DataFrame:
    return A.best_fit_line(t.predictions, "prediction", "target", ["grp"]).select(
        "grp", r("slope"), r("intercept", 3), r("r2"))


@query("""
SELECT grp, round(r, 6) AS r, df, round(r * sqrt(df / (1 - r * r)), 4) AS t FROM (
  SELECT grp, corr(target, prediction) AS r, count(*) - 2 AS df FROM predictions GROUP BY grp)""")
def pearson_test(t: Tables) -> DataFrame:
    return A.pearson_test(t.predictions, "prediction", "target", ["grp"]).select("grp", r("r"), "df", r("t", 4))


FRAME = "OVER (PARTITION BY run, metric ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
MOVING_SQL = f"""
SELECT run, metric, step, round(avg(value) {FRAME}, 6) AS mean, round(stddev_pop(value) {FRAME}, 5) AS std,
  min(value) {FRAME} AS min, max(value) {FRAME} AS max, value AS last FROM history"""


@query(MOVING_SQL)
def moving_stats(t: Tables) -> DataFrame:
    m = W.moving_stats(t.history, ["run", "metric"], window=10, block=16)
    return m.select("run", "metric", "step", r("mean"), r("std", 5), "min", "max", "last")


@query("""
SELECT metric, step, round(avg(value) OVER w + 1e-7::DOUBLE, 5) AS mean, min(value) OVER w AS min, max(value) OVER w AS max
FROM (SELECT event_type AS metric, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step, value FROM events)
WINDOW w AS (PARTITION BY metric ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def moving_stats_long(t: Tables) -> DataFrame:
    from doselake.functions.ranking import blocked_row_number

    e = t.raw("events").select(F.col("event_type").alias("metric"), "ts", "event_id", "value")
    series = blocked_row_number(e, ["metric"], [F.col("ts"), F.col("event_id")], F.to_date("ts"), "step")
    m = W.moving_stats(series, ["metric"], window=100, block=512)
    # the shift keeps exact halves away from the rounding
    return m.select("metric", "step", r(F.col("mean") + 1e-7, 5).alias("mean"), "min", "max")


SO_FAR = "OVER (PARTITION BY run, metric ORDER BY step ROWS UNBOUNDED PRECEDING)"


@query(f"""
SELECT run, metric, step, CASE WHEN step >= 3 THEN round(covar_pop(step, value) {SO_FAR} /
  nullif(sqrt(var_pop(step) {SO_FAR}) * sqrt(var_pop(value) {SO_FAR}), 0), 5) END AS pearson FROM history""")
def trend_corr(t: Tables) -> DataFrame:
    return W.trend_corr(t.history, ["run", "metric"], block=16).select("run", "metric", "step", r("pearson", 5))


@query("SELECT run, row_number() OVER (PARTITION BY run ORDER BY step) AS rn, step, value FROM history WHERE metric = 'click'")
def metric_history(t: Tables) -> DataFrame:
    return W.metric_history(t.history, "click", ["run"])


def _stop_sql(delta: float, patience: int, source: str = "history", keys: str = "run, metric") -> str:
    on = " AND ".join(f"h.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    h = ", ".join(f"h.{k.strip()}" for k in keys.split(","))
    return f"""
WITH RECURSIVE f AS (
  SELECT {keys}, step, value AS best, step AS best_step, 0 AS wait FROM {source} WHERE step = 1
  UNION ALL
  SELECT {h}, h.step, CASE WHEN h.value < f.best - {delta}::DOUBLE THEN h.value ELSE f.best END,
    CASE WHEN h.value < f.best - {delta}::DOUBLE THEN h.step ELSE f.best_step END,
    CASE WHEN h.value < f.best - {delta}::DOUBLE THEN 0 ELSE f.wait + 1 END
  FROM f JOIN {source} h ON {on} AND h.step = f.step + 1 WHERE f.wait < {patience})
SELECT {keys}, CASE WHEN max(wait) >= {patience} THEN max(step) END AS stop_step,
  max(best_step) AS best_step, min(best) AS best_value FROM f GROUP BY {keys}"""


@query(_stop_sql(0.0, 5))
def early_stop(t: Tables) -> DataFrame:
    s = W.early_stop(t.history, ["run", "metric"], patience=5, block=8)
    return s.select("run", "metric", "stop_step", "best_step", "best_value")


@query(_stop_sql(2.5, 4))
def early_stop_min_delta(t: Tables) -> DataFrame:
    s = W.early_stop(t.history, ["run", "metric"], patience=4, min_delta=2.5, block=8)
    return s.select("run", "metric", "stop_step", "best_step", "best_value")


@query("""
SELECT run, metric, any_value(b.step) AS best_step, any_value(b.value) AS best_value, any_value(l.step) AS last_step,
  any_value(l.value) AS last_value FROM
  (SELECT *, row_number() OVER (PARTITION BY run, metric ORDER BY value DESC, step) AS rn FROM history) b
  JOIN (SELECT *, row_number() OVER (PARTITION BY run, metric ORDER BY step DESC) AS rn FROM history) l USING (run, metric)
WHERE b.rn = 1 AND l.rn = 1 GROUP BY run, metric""")
def best_and_last(t: Tables) -> DataFrame:
    return W.best_and_last(t.history, ["run", "metric"], mode="max")


@query("""
SELECT run, metric, step, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value, step, metric) AS rank FROM history)
WHERE rank <= 3""", ints=("rank",))
def keep_top_k(t: Tables) -> DataFrame:
    unique = F.struct("step", "metric")
    return W.keep_top_k(t.history.withColumn("at", unique), ["run"], 3, step="at").drop("at")


@query("SELECT l_partkey AS feature, round(s, 4) AS score FROM (SELECT l_partkey, avg(l_tax) - 0.04::DOUBLE AS s FROM lineitem GROUP BY 1) ORDER BY round(abs(s), 9) DESC, l_partkey LIMIT 20")
def top_features(t: Tables) -> DataFrame:
    s = t.raw("lineitem").groupBy(F.col("l_partkey").alias("feature")).agg((F.avg("l_tax") - 0.04).alias("raw"))
    top = W.top_features(s.withColumn("score", F.round("raw", 9)), 20)
    return top.select("feature", r(F.col("raw"), 4).alias("score"))


@query("SELECT l_suppkey AS grp, n, row_number() OVER (ORDER BY n DESC, l_suppkey) AS rank FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)")
def rank_groups(t: Tables) -> DataFrame:
    n = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return W.rank_groups(n, "grp", "n")


@query(f"""
WITH m AS (SELECT run, {METRIC_SQL} FROM predictions GROUP BY run)
SELECT 'r2' AS metric, (SELECT run FROM m ORDER BY r2 DESC, run LIMIT 1) AS best_label, max(r2) AS best_value FROM m
UNION ALL SELECT 'pearson', (SELECT run FROM m ORDER BY pearson DESC, run LIMIT 1), max(pearson) FROM m
UNION ALL SELECT 'mae', (SELECT run FROM m ORDER BY mae, run LIMIT 1), min(mae) FROM m""")
def best_per_column(t: Tables) -> DataFrame:
    m = _metrics(A.regression_metrics(t.predictions, ["run"]), "run")
    return W.best_per_column(m, "run", ["r2", "pearson"], ["mae"])


@query("SELECT grp, run, round(avg(target), 3) AS score FROM predictions GROUP BY grp, run")
def sort_within_group(t: Tables) -> DataFrame:
    s = t.predictions.groupBy("grp", "run").agg(r(F.avg("target"), 3).alias("score"))
    return W.sort_within_group(s, "grp", "run")


@query("SELECT sig_id, run AS member, prediction FROM predictions WHERE run IN (SELECT DISTINCT run FROM predictions ORDER BY run LIMIT 5)")
def limit_ensemble(t: Tables) -> DataFrame:
    p = t.predictions.select("sig_id", F.col("run").alias("member"), "prediction")
    return W.limit_ensemble(p).select("sig_id", "member", "prediction")


@query("""
SELECT sig_id, round(avg(prediction), 4) AS prediction, CASE WHEN count(*) > 1 THEN round(stddev_pop(prediction), 4) END AS std,
  count(*) AS n_members FROM predictions GROUP BY sig_id""")
def ensemble_mean_std(t: Tables) -> DataFrame:
    p = t.predictions.select("sig_id", F.col("run").alias("member"), "prediction")
    return L.ensemble_mean_std(p).select("sig_id", r("prediction", 4), r("std", 4), "n_members")
