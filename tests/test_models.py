"""Splits, regressors against closed forms, and streams against batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doselake.operators import history as W
from doselake.operators import models as L
from doselake.operators import split as X
from doselake.operators import stats as A
from doselake.plans.stream_queries import drain
from doselake.sources.tables import sample_rows
from doselake.streaming import metrics as R


def counts(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


def test_random_split_sizes(spark):
    df = spark.range(103).toDF("k")
    assert counts(X.split_random(df, "k", 0.2, 0.1)) == {"test": 21, "val": 11, "train": 71}
    assert counts(X.split_random(df, "k", 0.0, 0.0)) == {"train": 103}
    a = X.split_random(df, "k", seed=1).collect()
    b = X.split_random(df.repartition(5), "k", seed=1).collect()
    assert sorted(a) == sorted(b)
    with pytest.raises(ValueError):
        X.split_random(df, "k", 0.6, 0.4)


@pytest.mark.parametrize("rows", [
    [(i // 20, i) for i in range(100)],
    [(None if i % 3 == 0 else 7, i % 2) for i in range(100)],
    [(1, 1)] * 100,
])
def test_splits_of_repeating_keys_are_exact(spark, rows):
    df = spark.createDataFrame(rows, "k int, v int")
    assert counts(X.split_random(df, "k", 0.1, 0.1)) == {"test": 10, "val": 10, "train": 80}
    a, b = (sorted(map(str, X.split_random(d, "k", 0.1, 0.1).collect())) for d in (df, df.repartition(5)))
    assert a == b
    folds = X.kfold(df, "k", 7).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in folds] == [15, 15, 14, 14, 14, 14, 14]
    sized = X.split_stratified(df.withColumn("s", F.lit("one")), "k", "s", 0.1, 0.1)
    assert counts(sized) == {"test": 10, "val": 10, "train": 80}
    runs = X.repeated_splits(df, "k", 2, 0.1, 0.1).where("split = 'test'").groupBy("run").count().collect()
    assert [r["count"] for r in runs] == [10, 10]
    assert sample_rows(df, 10, "k").count() == 10 and sample_rows(df, 1000, "k").count() == 100


def test_streams_treat_gaps_as_the_batch_does(spark, tmp_path):
    rows = [(1, i, v) for i, v in enumerate([1.0, float("nan"), None, float("nan"), float("nan"), 0.5, 0.4])]
    rows += [(2, 0, None), (2, 1, 3.0), (2, 2, 1.0)]
    df = spark.createDataFrame(rows, "k int, step bigint, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = drain(R.stream_early_stop(s, ["k"], patience=3), "gaps").collect()
    want = W.early_stop(df, ["k"], patience=3).where("stop_step IS NOT NULL").collect()
    assert [(r["k"], r["stop_step"]) for r in out] == [(r["k"], r["stop_step"]) for r in want] == [(1, 4)]
    cols = ["k", "step", "mean", "std", "min", "max", "last"]
    live = drain(R.stream_moving_stats(s, ["k"], window=3), "gaps").select(cols).orderBy("k", "step").collect()
    batch = W.moving_stats(df, ["k"], window=3, block=4).select(cols).orderBy("k", "step").collect()
    assert str(live) == str(batch)


def test_group_split_is_pure(spark):
    df = spark.range(600).select(F.col("id").alias("k"), F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 10).alias("g"))
    out = X.split_group(df, "g", 0.2, 0.1)
    assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    per = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.countDistinct("g").alias("n")).collect()}
    assert per == {"test": 2, "val": 1, "train": 7}
    with pytest.raises(ValueError):
        X.split_group(df.withColumn("g", F.col("k") % 2), "g")
    with pytest.raises(ValueError):
        X.split_with_roles(df.withColumn("g", F.lit(1)), "k", group_by="g")


def test_ratio_split(spark):
    df = spark.range(100).select(
        F.col("id").alias("k"), F.concat(F.lit("group_"), (F.col("id") % 5).cast("string")).alias("cell_mfc_name"))
    for by in (None, "cell_mfc_name"):
        out = X.split_ratio(df, "k", 0.7, 0.2, 0.1, by)
        assert counts(out) == {"train": 70, "val": 20, "test": 10}
        assert "cell_mfc_name" not in out.columns
    with pytest.raises(ValueError, match="Ratios must sum to 1"):
        X.split_ratio(df, "k", 0.6, 0.3, 0.2)
    with pytest.raises(KeyError):
        X.split_ratio(df, "k", 0.7, 0.2, 0.1, "non_existent_column")
    with pytest.raises(ValueError, match="Need at least 2 groups"):
        X.split_ratio(df.withColumn("cell_mfc_name", F.lit("one")), "k", 0.7, 0.2, 0.1, "cell_mfc_name")


def test_folds(spark):
    df = spark.range(23).toDF("k")
    sizes = sorted(r["count"] for r in X.kfold(df, "k", 5).groupBy("fold").count().collect())
    assert sizes == [4, 4, 5, 5, 5]
    assert X.kfold(df.limit(3), "k", 5).select("fold").distinct().count() == 3
    assert X.kfold(df, "k", 1).select("fold").distinct().count() == 1


RNG = np.random.default_rng(11)
D = RNG.normal(0, 1, (200, 4)) * [1, 5, 0.2, 2] + [3, 0, 1, -2]
Y = D @ [1.0, -0.5, 4.0, 0.0] + 7 + RNG.normal(0, 0.8, 200)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, [float(v) for v in d], float(y), i % 6) for i, (d, y) in enumerate(zip(D, Y))]
    return spark.createDataFrame(data, "sig_id bigint, values array<double>, y double, cell int")


def centred():
    return D - D.mean(0), Y - Y.mean()


@pytest.mark.parametrize("alpha", [0.1, 50.0])
def test_ridge(rows, alpha):
    x, y = centred()
    w = np.linalg.solve(x.T @ x + alpha * np.eye(4), x.T @ y)
    m = L.fit_ridge(rows, "y", alpha)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-8)
    assert m.intercept == pytest.approx(Y.mean() - D.mean(0) @ w)


def descend(l1, l2):
    x, y = centred()
    w, n = np.zeros(4), len(y)
    for _ in range(5000):
        for j in range(4):
            r = y - x @ w + x[:, j] * w[j]
            rho = x[:, j] @ r / n
            w[j] = np.sign(rho) * max(abs(rho) - l1, 0) / (x[:, j] @ x[:, j] / n + l2)
    return w


def test_lasso_and_elastic_net(rows):
    assert np.allclose(L.fit_lasso(rows, "y", 0.3).coefficients.toArray(), descend(0.3, 0), atol=1e-4)
    assert np.allclose(L.fit_elastic_net(rows, "y", 0.5, 0.4).coefficients.toArray(), descend(0.2, 0.3), atol=1e-4)


def test_linear_and_robust(rows):
    x = np.column_stack([np.ones(200), D])
    w = np.linalg.lstsq(x, Y, rcond=None)[0]
    assert np.allclose(L.fit_linear(rows, "y").coefficients.toArray(), w[1:])
    spoiled = rows.withColumn("y", F.when(F.col("sig_id") < 10, 500.0).otherwise(F.col("y")))
    huber = L.fit_huber(spoiled, "y").coefficients.toArray()
    plain = L.fit_linear(spoiled, "y").coefficients.toArray()
    assert np.abs(huber - w[1:]).max() < 0.5 < np.abs(plain - w[1:]).max()


def test_bayesian_ridge(rows, tmp_path, spark):
    m = L.fit_bayesian_ridge(rows, "y")
    x, y = centred()
    w = np.linalg.solve(x.T @ x, x.T @ y)
    assert np.allclose(m.coefficients, w, rtol=0.02, atol=0.02)
    assert np.linalg.norm(m.coefficients) < np.linalg.norm(w)  # shrunk
    path = L.save_model(m, str(tmp_path / "m"))
    back = L.predict(L.load_model(L.LinearTableModel, path), rows)
    want = D @ m.coefficients + m.intercept
    assert np.allclose([r["prediction"] for r in back.orderBy("sig_id").collect()], want)


def test_trees_and_search(rows):
    forest = L.fit_random_forest(rows, "y", numTrees=5, maxDepth=4)
    scored = L.predict(forest, rows).withColumn("target", F.col("y"))
    assert A.regression_metrics(scored).first()["r2"] > 0.5
    assert L.feature_importance(forest, rows).count() == 4
    assert L.predict(L.fit_gbt(rows, "y", maxIter=3), rows).count() == 200
    picks = L.random_grid(L.FOREST_GRID, 4)
    assert len({tuple(sorted(p.items())) for p in picks}) == 4 and picks == L.random_grid(L.FOREST_GRID, 4)
    assert len(L.random_grid({"a": [1, 2]}, 9)) == 2


def test_search_picks_a_model(rows, monkeypatch):
    monkeypatch.setitem(L.__dict__, "BOOST_GRID", {"maxIter": [2, 3], "maxDepth": [2]})
    assert L.predict(L.fit_gbt(rows, "y", n_iter=2), rows).count() == 200


def test_model_selection(rows):
    alpha, scores = L.choose_alpha(rows, L.fit_ridge, "y", [0.01, 1e6], folds=3)
    assert alpha == 0.01 and scores.count() == 2
    cv = L.cv_score(rows, L.fit_linear, "y", folds=3, metric="weighted_score").first()
    assert 0.5 < cv["cv_mean"] <= 1 and cv["cv_std"] >= 0


def test_repeated_fits(rows):
    scores = L.repeat_fit(rows, L.fit_linear, "y", 2, group="cell")
    assert scores.count() == 6
    summary = L.repeat_summary(scores)
    assert summary.count() == 6 and summary.where("n_runs = 2").count() == 6


def test_elastic_net_search(rows, monkeypatch):
    monkeypatch.setitem(L.__dict__, "ALPHAS", [0.01, 10.0])
    monkeypatch.setitem(L.__dict__, "L1_RATIOS", [0.2, 0.8])
    (alpha, share), model = L.choose_elastic_net(rows, "y", folds=2)
    assert alpha == 0.01 and share in (0.2, 0.8) and len(model.coefficients) == 4


def test_ablation_of_any_model(rows):
    model = L.fit_random_forest(rows, "y", numTrees=3, maxDepth=3)
    out = L.feature_ablation(model, rows.limit(5), [0, 2])
    assert out.count() == 10
    linear = L.fit_linear(rows, "y")
    got = {(r["sig_id"], r["feature"]): r["attribution"] for r in L.feature_ablation(linear, rows, [1]).collect()}
    assert np.allclose([got[(i, 1)] for i in range(200)], D[:, 1] * linear.coefficients[1])


def test_improvements_of_a_batch():
    rng = np.random.default_rng(7)
    for _ in range(300):
        v = np.where(rng.random(20) < 0.1, np.nan, rng.integers(-5, 5, 20).astype(float))
        start, delta = rng.choice([np.inf, 1.0]), rng.choice([0.0, 1.5])
        best, want = start, []
        for i, x in enumerate(v):
            if x < best - delta:
                best = x
                want.append(i)
        at, low = R.improved(v, start, delta)
        assert at.tolist() == want and low.tolist() == v[want].tolist()


def test_stopped_keys_leave_a_flag_only(spark, tmp_path):
    """State is carried over micro-batches; a key that stopped holds no progress, and later rows do not start it anew."""
    def part(lo, hi):
        rows = [("up", i, float(i)) for i in range(lo, hi)] + [("down", i, -float(i)) for i in range(lo, hi)]
        return spark.createDataFrame(rows, "k string, step bigint, value double")

    parts = [part(0, 3), part(3, 6), part(6, 9), part(9, 30)]
    s = stream_of(spark, str(tmp_path), parts)
    state = str(tmp_path / "state")
    with R.rocks_state(spark):
        q = R.stream_early_stop(s, ["k"], patience=4).writeStream.format("parquet").option("checkpointLocation", state)
        q.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        progress = spark.read.format("statestore").option("stateVarName", "progress").load(state)
        assert [r.key.k for r in progress.collect()] == ["down"]
        flags = spark.read.format("statestore").option("stateVarName", "stopped").load(state)
        assert [r.key.k for r in flags.collect()] == ["up"]
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.k, r.stop_step, r.best_step, r.best_value) for r in out] == [("up", 4, 0, 0.0)]


def test_groups_of_keys_share_state(spark, tmp_path):
    """Many keys in few groups, missing and text ones too, over micro-batches."""
    value = F.when(F.col("id") % 11 != 3, F.hash("id") % 100).cast("double")
    made = spark.range(600).select(
        F.when(F.col("id") % 7 != 0, F.col("id") % 7).alias("k"), F.concat(F.lit('"'), F.col("id") % 3).alias("m"),
        F.timestamp_seconds(F.col("id") % 2 + 0.25).alias("t"), F.col("id").alias("step"), value.alias("value"))
    parts = [made.where((F.col("step") >= lo) & (F.col("step") < hi)) for lo, hi in ((0, 50), (50, 300), (300, 600))]
    s = stream_of(spark, str(tmp_path), parts)
    keys = ["k", "m", "t"]
    state, stops = {}, set()
    for r in made.where("value IS NOT NULL").orderBy("step").collect():
        best, at, wait, done = state.get(r[:3], (np.inf, None, 0, False))
        if not done:
            best, at, wait = (r.value, r.step, 0) if r.value < best else (best, at, wait + 1)
            if wait >= 6:
                stops.add((*r[:3], r.step, at, best))
            state[r[:3]] = best, at, wait, wait >= 6
    got = drain(R.stream_early_stop(s, keys, patience=6, groups=3), "stops").collect()
    assert len(got) == len(stops) and set(map(tuple, got)) == stops
    window = Window.partitionBy(*keys).orderBy("step").rowsBetween(-4, 0)
    want = made.select(*keys, "step", *[f("value").over(window) for f in (F.min, F.max, F.avg)]).collect()
    got = drain(R.stream_moving_stats(s, keys, window=5, groups=3), "moving").select(*keys, "step", "min", "max", "mean").collect()
    close = lambda rows: {tuple(r[:6]): None if r[6] is None else round(r[6], 9) for r in rows}
    assert len(got) == len(want) and close(got) == close(want)


def test_ensemble(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 5.0)], "sig_id int, member string, prediction double")
    out = {r["sig_id"]: (r["prediction"], r["std"]) for r in L.ensemble_mean_std(df).collect()}
    assert out == {1: (2.0, 1.0), 2: (5.0, None)}


def stream_of(spark, folder, parts):
    """One file per part, one part per micro-batch."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    schema = parts[0].schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.fixture
def steps(spark):
    values = np.cumsum(np.random.default_rng(2).normal(-0.1, 1, 90))
    data = [("ab"[i % 3 == 0], i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "k string, step bigint, value double")


def test_streams_equal_batch(spark, steps, tmp_path):
    parts = [steps.where(F.col("step").between(lo, lo + 29)) for lo in (0, 30, 60)]
    s = stream_of(spark, str(tmp_path), parts)
    cols = ["k", "step", "mean", "std", "min", "max", "last"]
    batch = W.moving_stats(steps, ["k"], window=7, block=16).select(cols).orderBy("k", "step").collect()
    live = drain(R.stream_moving_stats(s, ["k"], window=7), "t").select(cols).orderBy("k", "step").collect()
    assert len(live) == 90
    for a, b in zip(batch, live):
        assert tuple(a[:2]) == tuple(b[:2]) and np.allclose(a[2:], b[2:])
    for delta in (0.0, 0.4):
        want = {r["k"]: (r["stop_step"], r["best_step"]) for r in
                W.early_stop(steps, ["k"], patience=6, min_delta=delta, block=8).where("stop_step IS NOT NULL").collect()}
        out = drain(R.stream_early_stop(s, ["k"], patience=6, min_delta=delta), "t")
        assert {r["k"]: (r["stop_step"], r["best_step"]) for r in out.collect()} == want and want
    with pytest.raises(ValueError):
        R.stream_early_stop(s, ["k"], mode="up")
