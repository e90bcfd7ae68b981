"""Selection, joins, statistics, and metric histories."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from doselake.operators import history as W
from doselake.operators import joins as J
from doselake.operators import select as P
from doselake.operators import stats as A


@pytest.fixture
def genes(spark):
    return spark.createDataFrame(
        [(0, "GeneA", "landmark"), (1, "GeneB", "best inferred"), (2, "GeneC", "other"), (3, "GeneD", "landmark")],
        "pos int, gene_symbol string, feature_space string")


def test_gene_selection(genes):
    def names(df):
        return sorted(r["gene_symbol"] for r in df.collect())

    assert names(P.gene_positions(genes, "landmark", "cumulative")) == ["GeneA", "GeneD"]
    assert names(P.gene_positions(genes, "best inferred", "cumulative")) == ["GeneA", "GeneB", "GeneD"]
    assert names(P.gene_positions(genes, "all", "cumulative")) == ["GeneA", "GeneB", "GeneC", "GeneD"]
    assert names(P.gene_positions(genes, "best inferred")) == ["GeneB"]
    assert names(P.gene_positions(genes, "all")) == ["GeneA", "GeneB", "GeneD"]
    for mode in ("exact", "cumulative"):
        with pytest.raises(ValueError):
            P.gene_positions(genes, "invalid_space", mode)
    with pytest.raises(ValueError):
        P.gene_positions(genes, "inferred")


def test_merge_target(spark):
    x = spark.createDataFrame([(1, 1, 3), (2, 2, 4)], "sig_id int, GeneA int, GeneB int")
    y = spark.createDataFrame([(1, 0.9, "Cell1", 10, 100), (2, 0.8, "Cell2", 20, 200)],
                              "sig_id int, viability double, cell_mfc_name string, pert_dose int, other int")
    out = P.merge_target(x, y)
    assert out.columns == ["sig_id", "GeneA", "GeneB", "viability", "cell_mfc_name", "pert_dose"]
    assert out.count() == 2
    with pytest.raises(KeyError):
        P.merge_target(x, y.drop("pert_dose"))
    with pytest.raises(KeyError):
        P.multimodal_view(x)


def test_rows_with_gaps(spark):
    df = spark.createDataFrame([(1, 1.0, [1.0, 2.0]), (2, None, [1.0, 2.0]), (3, 1.0, [None, 2.0]), (4, 1.0, [float("nan"), 1.0])],
                               "sig_id int, d double, values array<double>")
    assert [r["sig_id"] for r in P.drop_incomplete(df, ["d"]).collect()] == [1]
    assert [r["values"] for r in P.fill_zero(df, "values").orderBy("sig_id").collect()][2:] == [[0.0, 2.0], [0.0, 1.0]]


@pytest.fixture
def curves(spark):
    return spark.createDataFrame(
        [(1, 10, 0.0, 1.0, 0.0, "c1", "B1", "n1"), (2, 10, 1.0, 1.0, 0.0, "c1", "B1", "n1"), (3, 11, 0.0, 1.0, 0.5, "c1", "B2", "n2")],
        "experiment_id bigint, master_cpd_id bigint, p1_center double, p2_slope double, p4_baseline double, "
        "ccl_name string, broad_cpd_id string, cpd_name string")


def test_fallback_only_without_first_key(spark, curves):
    sig = spark.createDataFrame([(1, "c1", "B1", "n2", 1.0), (2, "c1", "zz", "n2", 1.0), (3, "c2", "B1", "n1", 1.0)],
                                "sig_id int, cell_mfc_name string, pert_mfc_id string, cmap_name string, pert_dose double")
    pairs = sorted((r["sig_id"], r["strategy"], r["experiment_id"]) for r in J.match_with_fallback(sig, curves).collect())
    assert pairs == [(1, 1, 1), (1, 1, 2), (2, 2, 3)]
    mean = {r["sig_id"]: r["viability"] for r in J.signature_viability(sig, curves).collect()}
    s = lambda x: 1 / (1 + np.exp(-x))
    assert mean[1] == pytest.approx((s(0) + s(-1)) / 2) and mean[2] == pytest.approx(0.75)
    first = {r["sig_id"]: r["experiment_id"] for r in J.signature_viability(sig, curves, "first").collect()}
    assert first == {1: 1, 2: 3}
    with pytest.raises(ValueError):
        J.signature_viability(sig, curves, "median")


def test_many_pairs_of_a_key_take_few_bytes(spark, tmp_path):
    mixed = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    key = F.concat(F.lit("n"), (F.col("id") % 8).cast("string"))
    sig = spark.range(8 * 60).select(
        mixed("id", 1 << 40).alias("sig_id"), F.lit("c1").alias("cell_mfc_name"), F.lit("zz").alias("pert_mfc_id"), key.alias("cmap_name"))
    many = spark.range(8 * 1501).select(
        mixed("id", 1 << 14).alias("experiment_id"), F.col("id").alias("master_cpd_id"), F.lit(0.0).alias("p1_center"),
        F.lit(1.0).alias("p2_slope"), F.lit(0.0).alias("p4_baseline"), F.lit("c1").alias("ccl_name"),
        F.concat(F.lit("B"), F.col("id").cast("string")).alias("broad_cpd_id"), key.alias("cpd_name"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        out = J.match_with_fallback(sig, many)
        out.select("sig_id", "strategy", "experiment_id", "master_cpd_id").write.parquet(str(tmp_path / "pairs"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    assert pairs.count() == pairs.distinct().count() == 8 * 60 * 1501
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 8 * 60 * 1501  # a byte a pair


def test_hot_pair_matches_brute_force(spark, curves):
    sig = spark.range(600).select(
        F.col("id").alias("sig_id"), F.lit("c1").alias("cell_mfc_name"),
        F.when(F.col("id") % 3 == 0, "B1").otherwise("B2").alias("pert_mfc_id"), F.lit("n1").alias("cmap_name"),
        (F.col("id") % 4 + 1.0).alias("pert_dose"))
    out = J.signature_viability(sig, curves).groupBy("n_curves").count().collect()
    assert sorted(map(tuple, out)) == [(1, 400), (2, 200)]
    assert J.match_pairs(sig, curves).count() == 200 * 2 + 400


def test_viability_adds_up_pairs_without_sorting(spark, curves, capsys):
    sig = spark.createDataFrame([(1, "c1", "B1", "n2", 1.0), (2, "c1", "zz", "n2", 1.0)],
                                "sig_id int, cell_mfc_name string, pert_mfc_id string, cmap_name string, pert_dose double")
    out = J.signature_viability(sig, curves, first_curve=True)
    out.explain()
    plan = capsys.readouterr().out
    assert "SortAggregate" not in plan
    assert sorted((r["sig_id"], r["experiment_id"], r["master_cpd_id"], r["n_curves"]) for r in out.collect()) == [(1, 1, 10, 2), (2, 3, 11, 1)]


def test_stacked_matches_are_not_stored(spark):
    from doselake.plans.registered import CATALOG
    from doselake.session import shared_dir

    def stored():
        return {os.path.join(d, f) for d, _, files in os.walk(shared_dir(spark).removeprefix("file:")) for f in files}

    before = stored()
    out = CATALOG["stack_matches"](spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and stored() == before


@pytest.mark.parametrize("combine", ["mean", "first"])
def test_viability_deals_the_curves_first(spark, curves, combine, capsys):
    sig = spark.createDataFrame([(1, "c1", "B1", "n2", 1.0)],
                                "sig_id int, cell_mfc_name string, pert_mfc_id string, cmap_name string, pert_dose double")
    J.signature_viability(sig, curves, combine).explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def test_no_shared_genes(spark, genes):
    net = spark.createDataFrame([("TFX", "TFY", 0.5)], "source string, target string, weight double")
    with pytest.raises(ValueError, match="No shared genes"):
        J.shared_genes(net, genes)


def test_constant_groups_do_not_fail(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0), ("b", 3.0, 2.0)], "g string, target double, prediction double")
    out = {r["g"]: r for r in A.regression_metrics(df, ["g"]).collect()}
    assert out["a"]["r2"] is None and out["a"]["pearson"] is None and out["a"]["mse"] == pytest.approx(2.5)
    assert out["b"]["r2"] == pytest.approx(0.5) and out["b"]["pearson"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        A.regression_metrics(df, names=["nope"])
    with pytest.raises(ValueError):
        A.loss(df, "nope")


def test_pivot_rejects_duplicates(spark):
    df = spark.createDataFrame([("f", "m", 1.0), ("f", "m", 2.0)], "f string, m string, v double")
    with pytest.raises(Exception, match="duplicate entries"):
        A.pivot_scores(df, "f", "m", "v", ["m"]).collect()


def test_histogram_of_constant(spark):
    rows = A.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [0, 0, 2, 0]
    assert rows[0]["left_edge"] == 1.5 and rows[3]["right_edge"] == 2.5


def series(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    rows = [("hot", s, float(v)) for s, v in enumerate(np.cumsum(rng.normal(-0.05, 1, n)))]
    rows += [("cold", s * 3, float(v)) for s, v in enumerate(rng.normal(0, 1, 25))]
    return spark.createDataFrame(rows, "k string, step bigint, value double"), pd.DataFrame(rows, columns=["k", "step", "value"])


def test_moving_stats_in_blocks(spark):
    df, pdf = series(spark)
    got = W.moving_stats(df, ["k"], window=20, block=32).toPandas().sort_values(["k", "step"]).reset_index(drop=True)
    roll = pdf.sort_values(["k", "step"]).groupby("k")["value"].rolling(20, min_periods=1)
    assert np.allclose(got["mean"], roll.mean().to_numpy())
    assert np.allclose(got["std"], roll.std(ddof=0).to_numpy())
    assert np.allclose(got["min"], roll.min().to_numpy())
    with pytest.raises(ValueError):
        W.moving_stats(df, ["k"], window=100, block=50)


def test_trend_in_blocks(spark):
    df, pdf = series(spark)
    got = W.trend_corr(df, ["k"], block=16).toPandas().set_index(["k", "step"])["pearson"]
    for k, part in pdf.groupby("k"):
        part = part.sort_values("step")
        for i in (1, 2, 9, 24):
            want = np.nan if i < 2 else np.corrcoef(part["step"][: i + 1], part["value"][: i + 1])[0, 1]
            assert np.isclose(got[(k, part["step"].iloc[i])], want, equal_nan=True)


def loop_stop(values, patience, delta, mode):
    sign = 1 if mode == "min" else -1
    best, best_at, wait = np.inf, None, 0
    for i, v in enumerate(values):
        if v * sign < best - delta:
            best, best_at, wait = v * sign, i, 0
        else:
            wait += 1
        if wait >= patience:
            return i, best_at
    return None, best_at


@pytest.mark.parametrize("delta,mode,patience", [(0.0, "min", 12), (0.0, "max", 12), (0.7, "min", 15), (0.7, "max", 30), (5.0, "min", 500)])
def test_early_stop_in_blocks(spark, delta, mode, patience):
    df, pdf = series(spark)
    out = {r["k"]: (r["stop_step"], r["best_step"]) for r in
           W.early_stop(df, ["k"], patience=patience, min_delta=delta, mode=mode, block=16).collect()}
    for k, part in pdf.groupby("k"):
        part = part.sort_values("step").reset_index(drop=True)
        stop, best = loop_stop(part["value"], patience, delta, mode)
        step = part["step"]
        assert out[k] == (None if stop is None else step[stop], step[best])


def test_early_stop_skips_absent_values(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 2.0), ("a", 3, float("nan"))], "k string, step bigint, value double")
    assert W.early_stop(df, ["k"], patience=2).first()["stop_step"] == 3
    with pytest.raises(ValueError):
        W.early_stop(df, ["k"], mode="up")


def test_describe_and_nulls(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (float("nan"), "b"), (4.0, "c")], "x double, s string")
    d = A.describe(df, ["x"]).first()
    want = pd.Series([1.0, 2.0, 4.0]).describe()
    assert d["count"] == 3 and d["std"] == pytest.approx(want["std"]) and d["q25"] == want["25%"]
    assert {r["column"]: r["n_missing"] for r in A.null_counts(df).collect()} == {"x": 1, "s": 1}
