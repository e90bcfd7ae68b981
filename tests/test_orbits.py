"""Improvements by a margin, followed by pointers, against the loop that defines them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from doselake.functions.orbits import orbit
from doselake.operators import history as W


def loop(values, delta):
    best, kept = np.inf, []
    for i, v in enumerate(values):
        if v < best - delta:
            best = v
            kept.append(i + 1)
    return kept


@pytest.mark.parametrize("delta", [0.5, 3.0, 1e6])
def test_margin_records_equal_the_loop(spark, delta):
    """One key with most of the lows, over many tasks; text and null keys; a key of one low."""
    rng = np.random.default_rng(3)
    lows = {"big": np.cumsum(-rng.exponential(1.0, 4000)), None: np.cumsum(-rng.exponential(2.0, 50)), "one": np.array([5.0]),
            "steep": -np.arange(30.0) ** 2, "inf": np.array([1.0, 0.5, -np.inf])}
    rows = [(k, i + 1, float(v)) for k, vs in lows.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, rn bigint, _v double").repartition(5)
    got = {}
    for r in W.margin_records(df, ["k"], delta).collect():
        got.setdefault(r.k, []).append(r.rn)
    assert {k: sorted(v) for k, v in got.items()} == {k: loop(v, delta) for k, v in lows.items()}
    assert W.margin_records(df.limit(0), ["k"], delta).count() == 0


def test_orbit_over_many_blocks(spark):
    """Pointers that mostly leave their block: rounds double what is known."""
    rng = np.random.default_rng(4)
    ids = np.concatenate([(b << 33) + np.arange(9) for b in range(40)])
    following = [int(ids[min(i + int(rng.integers(1, 14)), len(ids))]) if i + 14 < len(ids) else None for i in range(len(ids))]
    want, at = set(), {int(i): n for i, n in zip(ids, following, strict=True)}
    for start in (int(ids[0]), int(ids[5])):
        while start is not None:
            want.add(start)
            start = at[start]
    pointers = spark.createDataFrame([(int(i), n) for i, n in zip(ids, following, strict=True)], "id bigint, next bigint").repartition(4)
    got = orbit(pointers, spark.createDataFrame([(int(ids[0]),), (int(ids[5]),)], "id bigint"))
    assert sorted(r.id for r in got.collect()) == sorted(want)


def test_early_stop_with_margin(spark):
    rng = np.random.default_rng(5)
    walks = {k: np.cumsum(rng.normal(-0.2, 1, 300)) for k in ("a", "b", "c")}
    rows = [(k, i + 1, float(v)) for k, vs in walks.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, step bigint, value double")
    got = {r.k: (r.stop_step, r.best_step) for r in W.early_stop(df, ["k"], patience=20, min_delta=1.5, block=16).collect()}
    for k, vs in walks.items():
        best, at, wait, stop = np.inf, None, 0, None
        for i, v in enumerate(vs):
            if v < best - 1.5:
                best, at, wait = v, i + 1, 0
            else:
                wait += 1
            if wait >= 20:
                stop = i + 1
                break
        assert got[k] == (stop, at)
    assert W.early_stop(df.where(F.lit(False)), ["k"], min_delta=1.0).count() == 0
