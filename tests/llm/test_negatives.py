"""Hard negatives against brute force in Python integers, and the bounds that prune them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from doselake.llm import negatives

ROWS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, anchors, positives, count, low, high):
    rows = {(i, tuple(v), y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)}
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows]
    out = []
    for a, va, y in rows:
        if not anchors(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(va, v)), i, z) for i, v, z in rows if len(v) == len(va))
        mine = [(i, -s) for s, i, z in scored if z == y and i != a][:positives]
        for p, sp in mine:
            fit = [(i, -s) for s, i, z in scored if z != y and low * sp <= 100 * -s <= high * sp][:count]
            out += [(a, p, k + 1, i, sp, s) for k, (i, s) in enumerate(fit)]
    return sorted(out)


def vector(rng, n=8):
    return [float(np.float32(rng.gauss(0.3, 1))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, vector(rng), rng.choice([0, 0, 0, 1, 2])) for i in range(200)]
    out += [(300 + i, [1.0] * 8, i % 2) for i in range(40)]  # ties
    out += [(400, None, 1), (401, vector(rng), None), (None, vector(rng), 1), (402, [None] * 8, 0), (403, [float("nan")] * 8, 0), (404, [float("inf")] + [0.0] * 7, 0)]
    out += [(410, [0.0] * 8, 0), (411, [0.0] * 8, 1), (412, [], 0), (413, [], 1), (420, [], 0), (500, vector(rng, 3), 0), (501, vector(rng, 3), 0), (502, vector(rng, 3), 1)]
    return out + [out[10], out[10], (10, vector(rng), 1), (10, vector(rng), out[10][2]), (0, vector(rng), 0)]


@pytest.mark.parametrize("block", [None, 17, 100])
def test_equals_brute_force(spark, rows, block):
    df = spark.createDataFrame(rows, ROWS).withColumns({"id": F.lit(1), "key": F.lit("k"), "anchor": F.lit(2), "score": F.lit(3), "v": F.lit(4)}).repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, block_rows=block)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda a: a % 10 == 0, 5, 3, 50, 95)


def test_few_rows_and_none(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    assert negatives.mine(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert negatives.mine(df, F.lit(False)).count() == 0
    few = [(0, [1.0, 1.0], 0), (1, [1.0, 0.9], 0), (2, [0.9, 0.7], 1)]
    got = negatives.mine(spark.createDataFrame(few, ROWS), F.col("vec_id") == 0).collect()
    assert sorted(tuple(r) for r in got) == brute(few, lambda a: a == 0, 5, 3, 50, 95) and len(got) == 1


def test_large_components(spark):
    rng = random.Random(6)
    large = [(i, [float(np.float32(rng.gauss(1, 1) * 1e6)) for _ in range(4)], i % 3) for i in range(60)]
    got = negatives.mine(spark.createDataFrame(large, ROWS), F.col("vec_id") % 5 == 0, block_rows=20)
    assert sorted(tuple(r) for r in got.collect()) == brute(large, lambda a: a % 5 == 0, 5, 3, 50, 95)
    with pytest.raises(Exception, match="64 bits"):
        negatives.mine(spark.createDataFrame([(0, [1e12], 0), (1, [1e12], 0)], ROWS), F.col("vec_id") == 0).collect()


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(7)
    for dim in (1, 3, 4, 16, 17, 64):
        v = (rng.standard_normal((80, dim)) * 300).astype(np.int64)
        exact = v @ v.T
        block = negatives.Block(np.arange(80), np.zeros(80, int), np.zeros(80, int), v, negatives.summaries(v))
        reach_before = np.full(exact.shape, np.inf)
        for k in range(len(negatives.LEVELS)):
            m, s = block.level(k)
            reach = s @ s.T
            assert (np.abs(exact - m @ m.T) <= reach + 1e-6 * (np.abs(exact) + 1)).all()
            assert (reach <= reach_before + 1e-6 * np.abs(reach)).all()
            reach_before = reach


def test_summaries_spare_exact_scores(monkeypatch):
    """Where vectors are steady within segments, few pairs are left for exact scoring, and none that is asked for goes."""
    rng = np.random.default_rng(8)
    v = (np.repeat(rng.standard_normal((2000, 16)), 4, axis=1) * 300 + rng.standard_normal((2000, 64)) * 5).astype(np.int64)
    block = negatives.Block(np.arange(2000), np.zeros(2000, int), np.zeros(2000, int), v, negatives.summaries(v))
    who = block.part(slice(0, 1))
    exact = v @ v[0]
    low = np.sort(exact)[-20:-19].astype(float)
    made = []
    monkeypatch.setattr(negatives, "exact_scores", lambda a, b: made.append(len(b)) or a @ b.T)
    at, score, fit = negatives.scores(who, block, np.ones((1, 2000), bool), low, np.array([np.inf]))
    assert sorted(score[0, fit[0]]) == sorted(exact[exact >= low]) and sum(made) < 100


def test_best_breaks_ties_by_place():
    rng = np.random.default_rng(9)
    for _ in range(300):
        s = rng.integers(0, 4, rng.integers(0, 12))
        k = int(rng.integers(1, 6))
        assert negatives.best(s, k).tolist() == sorted(range(len(s)), key=lambda i: (-s[i], i))[:k]
