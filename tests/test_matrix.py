"""Matrix stages, neighbours, networks, and ontologies against brute force."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from doselake import registry as V
from doselake.operators import knn
from doselake.operators import matrix as M
from doselake.operators import network as G
from doselake.operators import ontology as O

RNG = np.random.default_rng(5)
X = RNG.normal(2.0, 1.5, (60, 7)) @ RNG.normal(0, 1, (7, 7)) + 3
X[:, 4] = 2.0  # a constant gene


def frame(spark, x, extra=None):
    rows = [(i, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "sig_id bigint, values array<double>")


def values(df, col="values"):
    return np.array([r[col] for r in df.orderBy("sig_id").collect()], dtype=float)


def test_scalers(spark, tmp_path):
    df = frame(spark, X)
    std = X.std(0)
    std[std < 1e-12] = 1.0
    model = V.create_transform("scale").fit(df.where("sig_id < 40"))
    sd = X[:40].std(0)
    sd[sd < 1e-12] = 1.0
    assert np.allclose(values(model.transform(df)), (X - X[:40].mean(0)) / sd)
    q = np.quantile(X, [0.1, 0.5, 0.9], axis=0)
    span = np.where(q[2] == q[0], 1.0, q[2] - q[0])
    robust = V.create_transform("robust", quantile_range=(10.0, 90.0)).fit(df)
    assert np.allclose(values(robust.transform(df)), (X - q[1]) / span)
    both = V.create_transform("compound", transforms=[{"type": "normalize"}, {"type": "scale"}]).fit(df)
    path = str(tmp_path / "chain")
    both.save(path)
    unit = X / np.linalg.norm(X, axis=1, keepdims=True)
    assert np.allclose(values(PipelineModel.load(path).transform(df)), (unit - unit.mean(0)) / unit.std(0))


def test_zero_row_survives_normalising(spark):
    df = frame(spark, np.array([[0.0, 0.0], [3.0, 4.0]]))
    assert values(M.L2Normalizer().transform(df)).tolist() == [[0.0, 0.0], [0.6, 0.8]]


def gappy():
    x = X.copy()
    x[RNG.random(x.shape) < 0.1] = np.nan
    return x


def test_imputation(spark):
    x = gappy()
    df = frame(spark, x)
    for strategy, fn in (("mean", np.nanmean), ("median", np.nanmedian)):
        got = values(M.Imputer(strategy).fit(df).transform(df))
        assert np.allclose(got, np.where(np.isnan(x), fn(x, axis=0), x))
    with pytest.raises(ValueError):
        M.Imputer("mode")
    meta = spark.createDataFrame([(1.0, 1.0), (None, None), (2.0, 5.0), (6.0, 9.0)], "viability double, pert_dose double")
    assert (3.0, 5.0) in [tuple(r) for r in M.impute_metadata(meta, "mean").collect()]
    assert (2.0, 5.0) in [tuple(r) for r in M.impute_metadata(meta, "median").collect()]


def test_knn_imputation(spark):
    x = gappy()
    want = x.copy()
    for i in range(len(x)):
        for g in np.flatnonzero(np.isnan(x[i])):
            d = []
            for j in range(len(x)):
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if j != i and both.any() and not np.isnan(x[j, g]):
                    d.append((np.sqrt(((x[i] - x[j])[both] ** 2).sum() * x.shape[1] / both.sum()), j))
            want[i, g] = np.mean([x[j, g] for _, j in sorted(d)[:5]])
    assert np.allclose(values(knn.impute_knn(frame(spark, x), 5, block=16)), want)


@pytest.mark.parametrize("weights,p", [("uniform", 2.0), ("distance", 1.0)])
def test_knn_regression(spark, weights, p):
    df = frame(spark, X).withColumn("target", F.col("sig_id") * 1.5)
    train, test = df.where("sig_id < 45"), df.where("sig_id >= 40")  # five rows in both
    got = {r["sig_id"]: r["prediction"] for r in knn.knn_regress(train, test, 3, weights, p, block=8).collect()}
    for i in range(40, 60):
        d = (np.abs(X[:45] - X[i]) ** p).sum(1) ** (1 / p)
        near = np.lexsort((np.arange(45), d))[:3]
        y = near * 1.5
        if weights == "uniform":
            want = y.mean()
        elif (d[near] == 0).any():
            want = y[d[near] == 0].mean()
        else:
            want = (y / d[near]).sum() / (1 / d[near]).sum()
        assert got[i] == pytest.approx(want)


def test_outliers(spark):
    df = frame(spark, X)
    got = M.clip_outliers(df, 1.2)
    lo, hi = X.mean(0) - 1.2 * X.std(0), X.mean(0) + 1.2 * X.std(0)
    assert np.allclose(values(got), np.clip(X, lo, hi))
    z = np.abs(X - X.mean(0)) / (X.std(0) + 1e-8)
    assert got.agg(F.sum("n_clipped")).first()[0] == (z > 1.2).sum()


def test_correlation_in_strips(spark):
    x = np.delete(X, 4, axis=1)
    products = {r["i"]: r["row"] for r in M.cross_products(frame(spark, x), 6, strip=4).collect()}
    assert np.allclose([products[i] for i in range(6)], x.T @ x)
    want = np.corrcoef(x.T)
    for r in M.corr_matrix(frame(spark, x)).collect():
        assert r["r"] == pytest.approx(want[r["i"], r["j"]])


def test_pca(spark):
    df = frame(spark, X)
    model = M.CenteredPCA(k=3).fit(df.where("sig_id < 50"))
    c = X[:50] - X[:50].mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(model.ratio, (s**2 / (s**2).sum())[:3])
    assert np.allclose(model.loadings.T @ model.loadings, np.eye(3), atol=1e-8)
    assert (model.loadings[np.abs(model.loadings).argmax(0), range(3)] > 0).all()
    got = values(model.transform(df), "components")
    assert np.allclose(got, (X - X[:50].mean(0)) @ model.loadings)
    full = M.CenteredPCA(variance=0.95).fit(df)
    assert full.ratio.sum() >= 0.95 and full.ratio[:-1].sum() < 0.95
    top = model.top_loadings(spark, 2).where("component = 0").orderBy("rank").collect()
    assert abs(top[0]["loading"]) >= abs(top[1]["loading"])
    with pytest.raises(ValueError):
        M.CenteredPCA()


def test_augmentation(spark):
    df = frame(spark, np.zeros((400, 5)))
    noise = values(V.create_augmentation("noise", mean=1.0, std=0.5).transform(df))
    assert abs(noise.mean() - 1.0) < 0.05 and abs(noise.std() - 0.5) < 0.03
    again = values(V.create_augmentation("noise", mean=1.0, std=0.5).transform(df.repartition(7)))
    assert np.array_equal(noise, again)
    dropped = values(V.create_augmentation("dropout", drop_prob=0.5).transform(frame(spark, np.ones((3, 40)))))
    assert (dropped == dropped[0]).all() and 0 < dropped[0].sum() < 40


def test_unknown_names():
    for make in (V.create_transform, V.create_features, V.create_augmentation):
        with pytest.raises(ValueError):
            make("unknown")


def test_hooks(spark):
    df = frame(spark, X)
    assert V.fit_transform(M.StandardScaler(), df).count() == 60
    assert V.fit_transform(M.L2Normalizer(), df).count() == 60
    assert V.fit_transform(lambda d: d.limit(3), df).count() == 3
    with pytest.raises(TypeError):
        V.fit_transform(3, df)
    f = V.create_features("descriptors", size=64)
    s = spark.createDataFrame([(1, "CC", 1.0)], "k int, s string, d double")
    assert f(s, "k", "s", "d").count() == 1


# networks


def network(spark):
    edges = [("T1", f"g{i}", 1.0 if i % 2 else -1.0) for i in range(0, 6)] + [("T2", f"g{i}", 1.0) for i in range(4, 11)]
    edges += [("T3", "g1", 1.0), ("T4", "absent", 1.0)]
    return spark.createDataFrame(edges, "source string, target string, weight double"), edges


def expression(spark):
    x = np.random.default_rng(9).normal(0, 1, (8, 14))
    rows = [(i, [float(v) for v in r], f"cell{i}", 0.5, 1.0) for i, r in enumerate(x)]
    m = spark.createDataFrame(rows, "sig_id bigint, values array<double>, cell_mfc_name string, viability double, pert_dose double")
    return m, spark.createDataFrame([(i, f"g{i}") for i in range(14)], "pos int, gene_symbol string"), x


def ols_t(y, a):
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    resid = y - a @ beta
    cov = np.linalg.inv(a.T @ a) * (resid @ resid) / (len(y) - a.shape[1])
    return beta / np.sqrt(np.diag(cov))


@pytest.mark.parametrize("shape", ["falling", "flat", "thin"])
def test_block_krylov_equals_numpy(spark, shape):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 40)) * (0.8 ** np.arange(40) if shape == "falling" else 1.0) + 50
    if shape == "thin":
        x[:, 5:] = x[:, :5] @ rng.standard_normal((5, 35))
    values_, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values_, vectors = values_[::-1], vectors[:, ::-1]
    model = M.CenteredPCA(k=4).fit(frame(spark, x))
    assert np.allclose(model.ratio, values_[:4] / values_.sum(), rtol=1e-7)
    assert np.allclose(np.abs((model.loadings * vectors[:, :4]).sum(axis=0)), 1, atol=1e-6)
    got = np.array([r["components"] for r in model.transform(frame(spark, x)).orderBy("sig_id").collect()])
    assert np.allclose(got, (x - x.mean(axis=0)) @ model.loadings)
    part = M.CenteredPCA(variance=0.97).fit(frame(spark, x))
    assert len(part.ratio) == np.searchsorted(np.cumsum(values_ / values_.sum()), 0.97) + 1


def test_krylov_with_restarts():
    """A small block over a wide operator: many passes, blocks kept are few."""
    rng = np.random.default_rng(6)
    u = np.linalg.qr(rng.standard_normal((500, 500)))[0]
    spectrum = 0.97 ** np.arange(500)
    calls = []

    def apply(v):
        calls.append(v.shape[1])
        return u @ (spectrum[:, None] * (u.T @ v))

    values_, vectors = M.leading_eigenvectors(apply, rng.standard_normal((500, 7)), 3)
    assert np.allclose(values_, spectrum[:3], rtol=1e-9) and np.allclose(np.abs((vectors * u[:, :3]).sum(axis=0)), 1, atol=1e-7)
    assert max(calls) <= 7 and len(calls) < 60


@pytest.mark.parametrize("gaps", [0, 3])
def test_ulm_equals_least_squares(spark, gaps):
    net, edges = network(spark)
    m, genes, x = expression(spark)
    if gaps:  # row i lacks the genes i and i + 1, row 0 all
        hole = F.transform("values", lambda v, i: F.when((i == F.col("sig_id")) | (F.col("sig_id") == 0), F.lit(None))
                           .when(i == F.col("sig_id") + 1, F.lit(float("nan"))).otherwise(v))
        m = m.withColumn("values", hole)
    got = {(r["sig_id"], r["source"]): r["activity"] for r in G.tf_activity_ulm(m, genes, net, min_n=2).collect()}
    assert len(got) == 16 and {k[1] for k in got} == {"T1", "T2"}
    shared = 11
    for tf in ("T1", "T2"):
        w = np.zeros(shared)
        for s, t, v in edges:
            if s == tf:
                w[int(t[1:])] = v
        for i in range(8):
            at = [g for g in range(shared) if not gaps or g not in (i, i + 1)]
            if gaps and i == 0:
                assert got[(i, tf)] is None
            else:
                assert got[(i, tf)] == pytest.approx(ols_t(x[i, at], np.column_stack([np.ones(len(at)), w[at]]))[1])


def test_mlm_equals_least_squares(spark):
    net, edges = network(spark)
    m, genes, x = expression(spark)
    copy = spark.createDataFrame([("T9", t, w) for s, t, w in edges if s == "T1"], net.schema)
    got = {(r["sig_id"], r["source"]): r["activity"] for r in G.tf_activity_mlm(m, genes, net.unionByName(copy)).collect()}
    assert {k[1] for k in got} == {"T1", "T2", "T3"}  # T9 repeats T1, T4 has no gene
    a = np.ones((11, 4))
    a[:, 1:] = 0
    for s, t, v in edges:
        if s in ("T1", "T2", "T3"):
            a[int(t[1:]), int(s[1:])] = v
    for i in range(8):
        assert np.allclose([got[(i, f"T{j}")] for j in (1, 2, 3)], ols_t(x[i, :11], a)[1:])


@pytest.mark.parametrize("cells", [1 << 20, 8])
def test_mlm_with_gaps_equals_least_squares(spark, monkeypatch, cells):
    """A row's missing genes are left out of its fit; few cells make many blocks of genes and factors."""
    monkeypatch.setattr(G, "CELLS", cells)
    rng = np.random.default_rng(12)
    w = rng.normal(size=(30, 5)) * (rng.random((30, 5)) < 0.6)
    w[7] = [0, 0, 0, 0, 2.0]
    w[:, 3] = w[:, 1] - 2 * w[:, 2]  # depends on earlier ones
    net = spark.createDataFrame([(f"F{j}", f"g{i}", float(w[i, j])) for i in range(30) for j in range(5)], "source string, target string, weight double")
    genes = spark.createDataFrame([(i + 3, f"g{i}") for i in range(30)], "pos int, gene_symbol string")
    x = rng.normal(size=(12, 33))
    x[1, 5:8], x[2, [4, 20]], x[3, 3:30], x[4] = np.nan, np.nan, np.nan, np.nan
    x[5, [4, 20]] = np.nan  # the gaps of row 2
    m = frame(spark, x)
    got = {(r["sig_id"], r["source"]): r["activity"] for r in G.tf_activity_mlm(m, genes, net).collect()}
    assert {k[1] for k in got} == {"F0", "F1", "F2", "F4"} and len(got) == 48
    a = np.column_stack([np.ones(30), w[:, [0, 1, 2, 4]]])
    for i in range(12):
        at = ~np.isnan(x[i, 3:])
        mine = [got[(i, f"F{j}")] for j in (0, 1, 2, 4)]
        if at.sum() <= 5:
            assert mine == [None] * 4
        else:
            assert np.allclose(mine, ols_t(x[i, 3:][at], a[at])[1:]), i
    single = {(r["sig_id"], r["source"]): r["activity"] for r in G.tf_activity_ulm(m, genes, net, metadata=()).collect()}
    assert len(single) == 60
    for i in (0, 1, 2, 5, 11):
        at = ~np.isnan(x[i, 3:])
        for j in range(5):
            assert single[(i, f"F{j}")] == pytest.approx(ols_t(x[i, 3:][at], np.column_stack([np.ones(at.sum()), w[at, j]]))[1])


def test_mlm_factor_lost_in_gaps(spark):
    """A factor whose only genes a row lacks cannot be told from the rest: the row's values are null."""
    net = spark.createDataFrame([("A", "g0", 1.0), ("B", "g1", 1.0), ("B", "g2", -1.0)] + [("C", f"g{i}", float(i)) for i in range(8)], "source string, target string, weight double")
    genes = spark.createDataFrame([(i, f"g{i}") for i in range(8)], "pos int, gene_symbol string")
    x = np.random.default_rng(1).normal(size=(2, 8))
    x[1, 0] = np.nan
    got = G.tf_activity_mlm(frame(spark, x), genes, net).collect()
    assert all((r["activity"] is None) == (r["sig_id"] == 1) for r in got) and len(got) == 6


def test_activity_errors(spark):
    net, _ = network(spark)
    m, genes, _ = expression(spark)
    with pytest.raises(ValueError, match="Missing expected metadata columns"):
        G.tf_activity_ulm(m.drop("viability"), genes, net)
    alien = spark.createDataFrame([("TFX", "TFY", 0.5)], net.schema)
    with pytest.raises(ValueError, match="No shared genes found"):
        G.tf_activity_ulm(m, genes, alien)
    with pytest.raises(ValueError):
        G.tf_activity_ulm(m, genes, net.drop("weight"))


def test_sample_network(spark):
    m = spark.createDataFrame(
        [(1, "cell1", 0.8, 10, [1.2, 0.9, 1.4]), (2, "cell2", 0.6, 20, [0.5, 1.1, 1.2]), (3, "cell3", 0.9, 30, [0.8, 0.7, 0.6])],
        "sig_id int, cell_mfc_name string, viability double, pert_dose int, values array<double>")
    genes = spark.createDataFrame([(0, "TF1"), (1, "TF2"), (2, "TF3")], "pos int, gene_symbol string")
    net = spark.createDataFrame([("TF1", "TF2", 0.5), ("TF2", "TF3", 0.7)], "source string, target string, weight double")
    out = G.tf_activity_ulm(m, genes, net, min_n=1)
    assert "cell_mfc_name" in out.columns and out.select("sig_id").distinct().count() == 3


def test_last_duplicate_wins(spark):
    net = spark.createDataFrame([("T", "g", 1.0, 0), ("T", "g", -1.0, 1), ("U", "h", 1.0, 2)],
                                "source string, target string, weight double, row_no int")
    grid = {r["target"]: (r["T"], r["U"]) for r in G.gene_tf_matrix(net).collect()}
    assert grid == {"g": (-1.0, 0.0), "h": (0.0, 1.0)}
    assert G.gene_tf_matrix(net, ["g", "nope"], ["T", "nope"]).columns == ["target", "T"]
    with pytest.raises(ValueError):
        G.gene_tf_weights(net.drop("weight"))


# ontology


def test_diamond(spark):
    edges = spark.createDataFrame(
        [("root", "a"), ("root", "b"), ("a", "c"), ("b", "c"), ("c", "g1"), ("c", "g2"), ("b", "g3"), ("a", "x")],
        "parent string, child string").withColumn("relationship", F.lit("is_a"))
    genes = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "node string")
    sizes = {r["node"]: r["n_genes"] for r in O.term_sizes(edges, genes).collect()}
    assert sizes == {"root": 3, "a": 2, "b": 3, "c": 2, "g1": 0, "g2": 0, "g3": 0, "x": 0}
    kept = {(r["parent"], r["child"]) for r in O.filter_ontology(edges, genes).collect()}
    assert ("a", "x") not in kept and len(kept) == 7
    layers = {r["node"]: r["layer"] for r in O.ontology_layers(edges).collect()}
    assert layers == {"g1": 0, "g2": 0, "g3": 0, "x": 0, "c": 1, "a": 2, "b": 2, "root": 3}
    assert sorted(r["node"] for r in O.ontology_leaves(edges).collect()) == ["g1", "g2", "g3", "x"]
    assert {(r["term"], r["gene"]) for r in O.direct_genes(edges, genes).collect()} == {("c", "g1"), ("c", "g2"), ("b", "g3")}
    cycle = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "leaf")], "parent string, child string")
    with pytest.raises(ValueError):
        O.ontology_layers(cycle)
    below = {r["node"]: r["n_genes"] for r in O.term_sizes(cycle.union(cycle.limit(0)).union(
        spark.createDataFrame([("top", "a"), ("other", "g1")], cycle.schema)), genes.union(spark.createDataFrame([("leaf",)], genes.schema))).collect()}
    assert below == {"a": 1, "b": 1, "top": 1, "other": 1, "leaf": 0, "g1": 0}
    assert O.term_sizes(edges.limit(0), genes).count() == 0 and O.ontology_layers(edges.limit(0)).count() == 0


def test_random_graphs(spark):
    """Sizes and layers of random DAGs, with chains and genes that are terms, against recursion."""
    rng = np.random.default_rng(8)
    for trial in range(2):
        pairs = {(f"n{a}", f"n{b}") for a, b in zip(rng.integers(0, 60, 90), rng.integers(0, 60, 90)) if a < b}
        pairs |= {(f"c{i}", f"c{i + 1}") for i in range(12)} | {("c5", "n3"), ("n59", "c0")}
        genes = {f"n{i}" for i in range(30, 60, 2)} | {"c7"}
        children = {}
        for a, b in pairs:
            children.setdefault(a, set()).add(b)

        def below(node):
            out = set()
            for c in children.get(node, ()):
                out |= below(c) | ({c} & genes)
            return out

        def layer(node):
            return max((layer(c) + 1 for c in children.get(node, ())), default=0)

        names = {x for p in pairs for x in p}
        edges = spark.createDataFrame(sorted(pairs) * 2, "parent string, child string")
        known = spark.createDataFrame([(g,) for g in genes] * 2, "node string")
        assert {r["node"]: r["n_genes"] for r in O.term_sizes(edges, known).collect()} == {n: len(below(n)) for n in names}
        assert {r["node"]: r["layer"] for r in O.ontology_layers(edges).collect()} == {n: layer(n) for n in names}


def test_deep_chain_takes_few_rounds(spark):
    edges = spark.range(2000).select((F.col("id") + 1).cast("string").alias("parent"), F.col("id").cast("string").alias("child"))
    edges = edges.unionByName(spark.createDataFrame([("2000", "x"), ("7", "y")], edges.schema))
    layers = {r["node"]: r["layer"] for r in O.ontology_layers(edges).collect()}
    assert len(layers) == 2003 and all(layers[str(i)] == i for i in range(2001)) and layers["x"] == layers["y"] == 0
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], edges.schema)
    with pytest.raises(ValueError):
        O.ontology_layers(ring)


def test_wide_term_is_many_chunks(spark):
    genes = spark.range(70_000).select(F.concat(F.lit("g"), F.col("id")).alias("node"))
    edges = genes.select((F.hash("node") % 5).cast("string").alias("parent"), F.col("node").alias("child"))
    edges = edges.unionByName(edges.select(F.lit("root").alias("parent"), F.col("parent").alias("child")).distinct())
    bits, _ = O.descendant_bits(edges, genes)
    root = bits.where("node = 'root'").agg(F.count("*").alias("n"), F.sum(F.bitmap_count("bits")).alias("genes")).first()
    assert root.n >= 3 and root.genes == 70_000
