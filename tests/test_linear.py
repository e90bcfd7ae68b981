"""Linear fits from cross products against NumPy: many strips and folds, paths of penalties, and the evidence."""

import numpy as np
import pytest

from doselake.operators import linear as K
from doselake.operators import models as L
from doselake.operators.split import kfold

RNG = np.random.default_rng(21)
N, WIDTH = 400, 64
X = RNG.normal(0, 1, (N, WIDTH)) @ (np.eye(WIDTH) + 0.3 * RNG.normal(0, 1, (WIDTH, WIDTH)) / 8) + 100
B = np.where(np.arange(WIDTH) % 5 == 0, RNG.normal(0, 2, WIDTH), 0)
Y = X @ B + RNG.normal(0, 3, N) - 40


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, [float(v) for v in x], float(y)) for i, (x, y) in enumerate(zip(X, Y, strict=True))]
    data += [(1000, None, 1.0), (1001, [None] * WIDTH, 2.0), (1002, [1.0] * WIDTH, None)]
    return spark.createDataFrame(data, "sig_id bigint, values array<double>, y double").repartition(5)


def penalised(x, y, l1, l2):
    """Coefficients and intercept, by proximal gradient steps until nothing moves."""
    m, my = x.mean(axis=0), y.mean()
    a, b = x - m, y - my
    g, c = a.T @ a / len(y), a.T @ b / len(y)
    w = np.linalg.solve(g + l2 * np.eye(len(g)), c)
    if l1:
        step, before = 1 / (np.linalg.eigvalsh(g).max() + l2), w
        for i in range(200_000):
            z = w + (i / (i + 3)) * (w - before)
            before = w
            w = z - step * (g @ z - c + l2 * z)
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            if np.abs(w - before).max() < 1e-13:
                break
    return w, my - m @ w


@pytest.mark.parametrize("strip", [1 << 22, 65 * 13])
@pytest.mark.parametrize(("l1", "l2"), [(0.0, 0.0), (0.0, 0.7), (0.4, 0.0), (0.2, 0.3)])
def test_penalties_in_strips(rows, monkeypatch, strip, l1, l2):
    monkeypatch.setattr(K, "STRIP", strip)
    monkeypatch.setattr(K, "HELD", 2 * strip)
    model = L.fit_penalised(rows, "y", l1, l2)
    w, bias = penalised(X, Y, l1, l2)
    assert np.allclose(model.coefficients, w, atol=1e-6)
    assert model.intercept == pytest.approx(bias, abs=1e-4)


def test_scores_of_folds_need_no_rows(rows, spark):
    complete = rows.where("sig_id < 1000")
    dealt = kfold(complete, "sig_id", 5)
    fold = {r.sig_id: r.fold for r in dealt.select("sig_id", "fold").collect()}
    of = np.array([fold[i] for i in range(N)])
    penalties = [lambda n: (0.0, 0.0), lambda n: (0.0, 100.0 / n), lambda n: (0.5, 0.0), lambda n: (1e9, 0.0)]
    got = {(r.candidate, r.fold): (r.r2, r.pearson) for r in K.fold_scores(K.cross_sums(dealt, "y", "values", "fold", 5), penalties, rows).collect()}
    assert len(got) == 20
    for f in range(5):
        train, held = of != f, of == f
        for i, p in enumerate(penalties):
            w, bias = penalised(X[train], Y[train], *p(train.sum()))
            pred, y = X[held] @ w + bias, Y[held]
            r2, pearson = got[(i, f)]
            assert r2 == pytest.approx(1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-7)
            assert pearson is None if i == 3 else pearson == pytest.approx(np.corrcoef(y, pred)[0, 1], abs=1e-7)
    # the same by fitting and scoring every fold on its rows
    held = L.cv_predictions(complete, L.fit_linear, "y")
    per = {r.fold: r.r2 for r in L.regression_metrics(held, ["fold"], ["r2"]).collect()}
    assert all(per[f] == pytest.approx(got[(0, f)][0], abs=1e-7) for f in range(5))


def test_features_that_depend_on_each_other(spark):
    x = np.column_stack([X[:, :3], X[:, 0] + X[:, 1], np.full(N, 5.0)])
    df = spark.createDataFrame([([float(v) for v in r], float(y)) for r, y in zip(x, Y, strict=True)], "values array<double>, y double")
    model = L.fit_linear(df, "y")
    a = x - x.mean(axis=0)
    fitted = a @ np.linalg.lstsq(a, Y - Y.mean(), rcond=None)[0]
    assert np.allclose(a @ np.asarray(model.coefficients), fitted)
    assert np.isfinite(L.fit_lasso(df, "y", 0.1).coefficients).all()


def evidence(x, y):
    """Closed form of each step, from all eigenvalues."""
    a, b = x - x.mean(axis=0), y - y.mean()
    lam, vec = np.linalg.eigh(a.T @ a)
    noise, weight, old = 1 / (b @ b / len(b)), 1.0, None
    for _ in range(300):
        w = vec @ ((vec.T @ (a.T @ b)) / (lam + weight / noise))
        used = (noise * lam / (weight + noise * lam)).sum()
        weight = (used + 2e-6) / (w @ w + 2e-6)
        noise = (len(b) - used + 2e-6) / (((b - a @ w) ** 2).sum() + 2e-6)
        if old is not None and np.abs(old - w).sum() < 1e-3:
            break
        old = w
    return vec @ ((vec.T @ (a.T @ b)) / (lam + weight / noise))


@pytest.mark.parametrize("strip", [1 << 22, 65 * 13])
def test_evidence_equals_closed_form(rows, monkeypatch, strip):
    monkeypatch.setattr(K, "STRIP", strip)
    model = L.fit_bayesian_ridge(rows, "y")
    want = evidence(X, Y)
    assert np.allclose(model.coefficients, want, atol=1e-6)
    assert model.intercept == pytest.approx(Y.mean() - X.mean(axis=0) @ want, abs=1e-4)


def test_evidence_with_an_estimated_trace(rows):
    model = K.fit_evidence(rows, "y", how=K.Evidence(probes=16))
    want = evidence(X, Y)
    assert np.abs(np.asarray(model.coefficients) - want).max() < 0.02 * np.abs(want).max()


def test_evidence_scores_by_fold(rows, monkeypatch):
    complete = rows.where("sig_id < 1000")
    fast = L.cv_score(complete, L.fit_bayesian_ridge, "y", folds=3).first()
    slow = L.cv_score(complete, lambda d, t: L.fit_bayesian_ridge(d, t), "y", folds=3).first()
    assert fast.cv_mean == pytest.approx(slow.cv_mean, abs=1e-6) and fast.cv_std == pytest.approx(slow.cv_std, abs=1e-6)


def test_huber_is_a_minimum(rows):
    """No small step away lowers the robust objective: scale and coefficients together."""
    model = L.fit_huber(rows.where("sig_id < 1000"), "y", epsilon=1.35, alpha=1e-4)
    w, bias, scale = np.asarray(model.coefficients), model.intercept, model.scale

    def objective(w, bias, scale):
        z = np.abs((Y - X @ w - bias) / scale)
        cost = np.where(z <= 1.35, z * z, 2 * 1.35 * z - 1.35 ** 2)
        return (scale + cost * scale).mean() / 2 + 1e-4 * (w @ w) / 2

    here, rng = objective(w, bias, scale), np.random.default_rng(1)
    assert objective(*(lambda b: (b, Y.mean() - X.mean(axis=0) @ b, scale))(np.zeros(WIDTH))) > here
    for _ in range(200):
        step = rng.normal(size=WIDTH) * 1e-2
        moved = objective(w + step, bias - X.mean(axis=0) @ step, scale * (1 + rng.normal() * 1e-2))
        assert moved > here - 1e-7


def test_nothing_to_fit(rows):
    with pytest.raises(ValueError, match="no complete row"):
        L.fit_linear(rows.where("sig_id >= 1000"), "y")
