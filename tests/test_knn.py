"""Exact neighbours against brute force: text keys, ties, gaps, many cells, and what pruning spares."""

import numpy as np
import pytest

from doselake.operators import knn

KEYED = "sig_id string, values array<double>, target double"


def table(spark, x, keys, y):
    rows = [(k, [None if np.isnan(v) else float(v) for v in r], t) for k, r, t in zip(keys, x, y, strict=True)]
    return spark.createDataFrame(rows, KEYED).repartition(3)


def clusters(rng, n, dim=6, centres=12):
    middle = rng.standard_normal((centres, dim)) * 20
    return middle[rng.integers(0, centres, n)] + rng.standard_normal((n, dim))


@pytest.mark.parametrize(("p", "weights"), [(2.0, "distance"), (1.0, "uniform"), (3.0, "uniform")])
def test_regression_with_text_keys_ties_and_missing(spark, p, weights):
    rng = np.random.default_rng(2)
    x = clusters(rng, 400)
    x[50:110] = x[50]  # equal rows: ties go to the smaller key
    keys = [f"s{rng.integers(10**9)}-{i}" for i in range(400)]
    y = [float(i) for i in range(400)]
    df = table(spark, x, keys, y)
    missing = table(spark, [[np.nan, *[0.0] * 5]], ["gap"], [1.0])
    got = {r.sig_id: r.prediction for r in knn.knn_regress(df.unionByName(missing), df.unionByName(missing), 4, weights, p, block=20).collect()}
    assert len(got) == 401 and got["gap"] is None
    for i in range(0, 400, 7):
        d = (np.abs(x - x[i]) ** p).sum(axis=1) ** (1 / p)
        near = sorted(range(400), key=lambda j: (d[j], keys[j]))[:4]
        if weights == "uniform":
            want = np.mean([y[j] for j in near])
        else:  # every row is in the training table
            want = np.mean([y[j] for j in near if d[j] == 0])
        assert got[keys[i]] == pytest.approx(want), i


def test_imputation_in_many_cells(spark):
    rng = np.random.default_rng(3)
    x = clusters(rng, 300)
    x[rng.random(x.shape) < 0.08] = np.nan
    x[5] = np.nan  # no distance at all: the gene means
    keys = [f"k{(i * 7919) % 1000:04d}" for i in range(300)]
    got = {r.sig_id: r["values"] for r in knn.impute_knn(table(spark, x, keys, [0.0] * 300), 3, block=16).collect()}
    mean = np.nanmean(x, axis=0)
    for i in range(300):
        for g in range(x.shape[1]):
            if not np.isnan(x[i, g]):
                assert got[keys[i]][g] == x[i, g]
                continue
            both = ~np.isnan(x) & ~np.isnan(x[i])
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.sqrt((np.where(both, x - x[i], 0) ** 2).sum(axis=1) * 6 / both.sum(axis=1))
            near = sorted((j for j in range(300) if j != i and both[j].any() and not np.isnan(x[j, g])), key=lambda j: (d[j], keys[j]))[:3]
            want = np.mean([x[j, g] for j in near]) if near else mean[g]
            assert got[keys[i]][g] == pytest.approx(want), (i, g)


def test_few_rows(spark):
    df = table(spark, [[1.0, 2.0], [1.0, 4.0]], ["a", "b"], [1.0, 3.0])
    assert {r.sig_id: r.prediction for r in knn.knn_regress(df, df, 5).collect()} == {"a": 2.0, "b": 2.0}
    assert [r.prediction for r in knn.knn_regress(df.limit(0), df, 5).collect()] == [None, None]
    assert knn.knn_regress(df, df.limit(0), 5).count() == 0
    assert knn.impute_knn(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        knn.knn_regress(df, df, weights="rank")
    with pytest.raises(ValueError):
        knn.knn_regress(df, df, p=0.5)


def test_bounds_hold_and_spare_cells(spark):
    rng = np.random.default_rng(4)
    for gaps in (0, 2):
        x = clusters(rng, 2000)
        for row in x[: 2000 * bool(gaps)]:
            row[rng.choice(6, gaps, replace=False)] = np.nan
        cells = knn.store_cells(table(spark, x, [str(i) for i in range(2000)], [0.0] * 2000), "sig_id", "values", [], 25, 2.0, gaps)
        q = x[:40]
        bound = knn.visits(cells, q, 2.0)
        stored = {c: np.concatenate([knn.as_block(b.column(1)) for b in cells.read(c, 7)]) for c in np.flatnonzero(np.isfinite(bound[0]))}
        assert sum(map(len, stored.values())) == 2000 and len(stored) > 40
        for c, rows in stored.items():
            apart = q[:, None] - rows[None]
            d = np.sqrt(np.nansum(apart * apart, axis=2)).min(axis=1)
            assert (bound[:, c] <= d).all()
        if not gaps:  # a query of a cluster need not read the others
            read = knn._searched(cells, q[:1], 2.0, 100, lambda: np.array([3.0]), lambda at, rows: None)
            assert read < len(stored) / 4


def test_smallest_takes_first_of_equals():
    rng = np.random.default_rng(5)
    for _ in range(100):
        d = rng.integers(0, 4, (3, 9)).astype(float)
        d[rng.random(d.shape) < 0.3] = np.inf
        row, column = knn.smallest(d, 3)
        for i in range(3):
            want = sorted((v, j) for j, v in enumerate(d[i]) if np.isfinite(v))[:3]
            assert sorted(column[row == i]) == sorted(j for _, j in want)


def test_rows_out_of_reach_are_not_ranked(spark, monkeypatch):
    """Once the queries have neighbours, a cell's rows are compared with their limit alone."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 6))
    x[rng.random(x.shape) < 0.05] = np.nan
    rows = [(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "sig_id bigint, values array<double>")
    gaps = int(np.isnan(x).sum(axis=1).max())
    cells = knn.store_cells(df, "sig_id", "values", [], 16, 2.0, gaps)
    ranked, exact = [], knn._exact
    monkeypatch.setattr(knn, "_exact", lambda d, *rest: ranked.append(d.size) or exact(d, *rest))
    asked = np.flatnonzero(np.isnan(x).any(axis=1))
    part = pa.RecordBatch.from_pydict({"key": pa.array(asked), "v": pa.array([rows[i][1] for i in asked], pa.list_(pa.float64()))})
    fills = knn._filled(cells, part, 3, 16, "sig_id").column(1).to_pylist()
    for i, filled in zip(asked, fills, strict=True):
        both = ~np.isnan(x[i]) & ~np.isnan(x)
        d = np.sqrt(np.where(both, (x[i] - x) ** 2, 0).sum(axis=1) * 6 / both.sum(axis=1))
        d[i] = np.inf
        for g, value in filled:
            near = np.argsort(np.where(np.isnan(x[:, g]), np.inf, d), kind="stable")[:3]
            assert value == pytest.approx(x[near, g].mean())
    assert sum(ranked) < np.isnan(x).sum() * len(x) / 2
