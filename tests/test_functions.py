"""Ranks, cuts, quantiles, skewed joins, and structure features."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doselake.functions import chem, dose, quantiles, text
from doselake.functions.quantiles import exact_quantiles
from doselake.functions.ranking import blocked_row_number, global_row_number, hash_cuts, seeded_hash
from doselake.functions.skew import hot_keys, hot_parts, salted_join


def skewed(spark, n=3000):
    """One key holds more than a third of all rows."""
    key = F.when(F.col("id") % 5 < 2, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string")))
    return spark.range(0, n, 1, 6).select("id", key.alias("k"), ((F.col("id") * 7919) % 1009 / 7.0).alias("v"))


def test_quantiles_match_numpy_per_key_and_overall(spark):
    df = skewed(spark, 6000)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    pdf = df.toPandas()
    for k, part in pdf.groupby("k"):
        assert np.allclose(got[k], np.quantile(part["v"], probs)), k
    whole = exact_quantiles(df, [], "v", probs).first()
    assert whole["n"] == 6000
    assert np.allclose(whole["q"], np.quantile(pdf["v"], probs))


def test_quantiles_with_one_dominant_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 3000, 1.5).otherwise(F.col("id") / 10.0).alias("v"))
    got = exact_quantiles(df, [], "v", [0.3, 0.5, 0.7]).first()["q"]
    assert np.allclose(got, np.quantile(df.toPandas()["v"], [0.3, 0.5, 0.7]))


def test_quantiles_ignore_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert exact_quantiles(df, [], "v", [0.5]).first()["q"] == [2.0]
    assert exact_quantiles(df.where("v IS NULL"), [], "v", [0.5]).count() == 0
    keyed = spark.createDataFrame([("a", 1.0), (None, 5.0), (None, float("inf")), ("b", None)], "k string, v double")
    assert {r.k: (r.n, r.q) for r in exact_quantiles(keyed, ["k"], "v", [0.5, 1.0]).collect()} == {
        "a": (1, [1.0, 1.0]), None: (2, [float("inf"), float("inf")])
    }


def test_ordered_keys():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 1 << 63, 5000).view(np.float64), [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, 1.0]])
    x = x[~np.isnan(x)]
    x = np.concatenate([x, -x])
    keys = quantiles.ordered(x)
    assert (quantiles.restored(keys) == x).all()
    rising = x[np.argsort(keys, kind="stable")]
    assert (rising[1:] >= rising[:-1]).all()
    assert keys[x == 0].max() == keys[x == 0].min()


@pytest.mark.parametrize("counters", [1 << 21, 40])
def test_array_quantiles_match_numpy(spark, monkeypatch, counters):
    """Gaps, one value, ties, narrow and huge ranges, an empty position; few counters make many passes."""
    monkeypatch.setattr(quantiles, "COUNTERS", counters)
    rng = np.random.default_rng(4)
    m = rng.standard_normal((700, 8))
    m[rng.random(m.shape) < 0.2] = np.nan
    m[:, 1], m[1:, 2], m[:, 3] = np.nan, np.nan, 7.0
    m[:, 4], m[:, 5], m[:, 6] = np.round(m[:, 4], 1), 1000 + rng.random(700) * 1e-9, m[:, 6] * 10.0 ** rng.integers(-300, 300, 700)
    m[5, 7], m[6, 7] = np.inf, -np.inf
    rows = [([None if np.isnan(v) else float(v) for v in r],) for r in m]
    df = spark.createDataFrame([*rows, (None,), ([],), ([0.5],)], "values array<double>").repartition(3)
    m = np.concatenate([m, [[0.5, *[np.nan] * 7]]])
    probs = [0.0, 0.25, 0.5, 0.99, 1.0] if counters > 100 else [0.5]
    got = quantiles.array_quantiles(df, probs).to_pydict()
    for g, x in enumerate(m.T):
        x = x[~np.isnan(x)]
        assert got["n"][g] == len(x)
        if not len(x):
            assert got["q"][g] is None
        elif np.isfinite(x).all():
            assert np.allclose(got["q"][g], np.quantile(x, probs), rtol=1e-12, atol=0)
        else:
            assert [got["q"][g][0], got["q"][g][-1]] == ([-np.inf, np.inf] if len(probs) > 1 else [np.median(x)] * 2)
        if len(x) and np.isfinite(x).all() and g != 6:
            assert np.allclose([got["mean"][g], got["m2"][g]], [x.mean(), ((x - x.mean()) ** 2).sum()], rtol=1e-9)
    assert len(quantiles.array_quantiles(df.limit(0), [0.5])) == 0


def test_blocked_row_number(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("v", "id")
    want = {r["id"]: r["rn"] for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    got = blocked_row_number(df, ["k"], [F.col("v"), F.col("id")], F.floor(F.col("v") / 9))
    assert {r["id"]: r["rn"] for r in got.collect()} == want


def test_global_row_number(spark):
    rows = global_row_number(skewed(spark), ["v", "id"], desc={"v"}).select("v", "id", "rn").collect()
    rows.sort(key=lambda r: (-r["v"], r["id"]))
    assert [r["rn"] for r in rows] == list(range(1, 3001))


def test_hash_cuts(spark):
    df = skewed(spark).withColumn("h", seeded_hash(1, "id"))
    cuts = {r["k"]: r["cuts"] for r in hash_cuts(df, "h", lambda n: [F.lit(1), n], ["k"]).collect()}
    pdf = df.toPandas().groupby("k")["h"]
    assert {k: c[0] for k, c in cuts.items()} == pdf.min().to_dict()
    assert {k: c[1] for k, c in cuts.items()} == pdf.max().to_dict()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    left = skewed(spark, 2000)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k7", 3), ("none", 4)], "k string, w int")
    plain = left.join(right, "k", how)
    salted = salted_join(left, right, ["k"], how, salts=8, share=0.1)
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.select(salted.columns).collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_with_hot_keys_on_both_sides(spark, how):
    """Hot on the left, on the right, on both; null keys never match."""
    left = skewed(spark, 1200).withColumn("k", F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 11 == 0, F.lit("both")).otherwise(F.col("k")))
    right = spark.range(0, 900, 1, 5).select(
        F.when(F.col("id") < 300, "k7").when(F.col("id") < 500, "both").when(F.col("id") < 600, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.col("id").alias("w"),
    )
    plain = left.join(right, "k", how)
    salted = salted_join(left, right, ["k"], how, share=0.05)
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.select(salted.columns).collect()))


def test_hot_right_key_is_split(spark):
    """No task of the join gets more than a part of a key that is hot on the right."""
    left = spark.range(40).select((F.col("id") % 20).alias("k"), F.col("id").alias("a"))
    right = spark.range(0, 8000, 1, 4).select(F.when(F.col("id") % 2 == 0, 3).otherwise(F.col("id") % 20).alias("k"), F.col("id").alias("b"))
    parts = {r["_h"]: (r["_a"], r["_b"]) for r in hot_parts(left, right, ["k"], 0.05, 64).collect()}
    key = spark.range(1).select(F.xxhash64(F.lit(3).cast("bigint"))).first()[0]
    assert parts[key][0] <= 2 and 10 <= parts[key][1] <= 12
    assert all(b <= 2 for h, (_, b) in parts.items() if h != key)


def test_hot_keys_finds_only_the_hot(spark):
    assert [r["k"] for r in hot_keys(skewed(spark), ["k"], 0.2).first()[0]] == ["hot"]


ASPIRIN = "CC(=O)OC1=CC=CC=C1C(=O)O"


def test_basic_descriptors(spark):
    df = spark.createDataFrame([(1, ASPIRIN, 2.5), (2, None, 1.0), (3, "ClCBr", 0.0)], "id int, s string, d double")
    out = {r["id"]: r["f"] for r in df.select("id", chem.basic_descriptors(F.col("s"), F.col("d")).alias("f")).collect()}
    assert out[1] == [9, 0, 4, 0, 5, 0, 4, 0, 24, 0, 2.5]
    assert out[2] == [0.0] * 10 + [1.0]
    assert out[3][0] == 2 and out[3][3] == 2  # the C of Cl counts as carbon too


def test_robust_descriptors(spark):
    df = spark.createDataFrame([(1, ASPIRIN, 2.5), (2, "C(", 1.0), (3, "C", 1.0), (4, "X1PS", 1.0)], "id int, s string, d double")
    rows = chem.robust_descriptors(df, "id", "s", "d").collect()
    assert [r["id"] for r in rows] == [1]
    f = rows[0]["features"]
    assert len(f) == 64 and f[:4] == [24, 9, 0, 4] and f[11] == 2 and f[63] == 2.5
    blank = chem.robust_descriptors(df.where("id = 2"), "id", "s", "d").collect()
    assert blank[0]["id"] is None and blank[0]["features"] == [0.0] * 64
    with pytest.raises(ValueError):
        chem.robust_descriptors(df, "id", "s", "d", size=5)
    assert len(chem.robust_descriptors(df, "id", "s", "d", size=15).first()["features"]) == 15


def test_tokens_and_characters(spark):
    df = spark.createDataFrame([(1, "CCl[NH3+]"), (2, "c1ccccc1Br")], "id int, s string")
    out = {r["id"]: r for r in chem.tokenize_fixed(df, "s", {"C": 1, "Cl": 2, "c": 3, "1": 4, "Br": 5}, 4, unknown_id=9).collect()}
    assert out[1]["token_ids"] == [1, 2, 9, 0] and out[1]["mask"] == [1, 1, 1, 0]
    assert out[2]["token_ids"] == [3, 4, 3, 3] and out[2]["mask"] == [1, 1, 1, 1]
    ids = {r["id"]: r["char_ids"] for r in chem.char_indices(df, "s", " ?CcNl1").collect()}
    assert ids[1] == [2, 2, 5, 1, 4, 1, 1, 1, 1, 0]
    vocabulary = spark.createDataFrame([("C", 1), ("c", 3)], "token string, id int")
    got = {r["id"]: r["token_ids"] for r in chem.tokenize_fixed(df, "s", vocabulary, 4, unknown_id=7).collect()}
    assert got == {1: [1, 7, 7, 0], 2: [3, 7, 3, 3]}


def test_vocabulary_in_many_parts(spark, monkeypatch):
    """A table of any size is looked up by parts; null, empty and unknown strings."""
    monkeypatch.setattr(chem, "PART_TOKENS", 500)
    vocabulary = spark.range(7000).select(F.concat(F.lit("w"), F.col("id")).alias("token"), F.col("id").alias("id"))
    rows = [(i, f"w{i * 37 % 9000} w{i}") for i in range(300)] + [(400, None), (401, ""), (402, "x")]
    df = spark.createDataFrame(rows, "k int, s string").repartition(4)
    out = {r.k: r for r in chem.tokenize_fixed(df, "s", vocabulary, 3, "[a-z][0-9]*", unknown_id=-1).collect()}
    for i in range(300):
        first = i * 37 % 9000
        assert out[i].token_ids == [first if first < 7000 else -1, i, 0] and out[i]["mask"] == [1, 1, 0]
    assert out[401].token_ids == [0, 0, 0] and out[402].token_ids == [-1, 0, 0]


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, ASPIRIN, 2.0), (2, " ", 1.0), (3, None, 1.0)], "id int, s string, d double")
    rows = chem.fingerprint_ngrams(df, "s", "d", size=128).collect()
    assert [r["id"] for r in rows] == [1]
    bits = rows[0]["features"]
    assert len(bits) == 129 and bits[-1] == 2.0 and set(bits[:-1]) == {0.0, 1.0}
    assert sum(bits[:-1]) <= len({ASPIRIN[i:i + 3] for i in range(len(ASPIRIN) - 2)})


def test_a_gram_of_many_rows_is_hashed_once(monkeypatch):
    import pyarrow as pa

    calls, md5 = [], chem.md5
    monkeypatch.setattr(chem, "md5", lambda b: calls.append(b) or md5(b))
    letters = "".join(map(chr, [*range(0x61, 0x7b), *range(0x400, 0x500), *range(0x1f600, 0x1f700)]))
    rng = np.random.default_rng(4)
    texts = ["abcabc"] * 300 + [None, "", "ab"] + ["".join(rng.choice(list(letters), 40)) for _ in range(30)]
    for n in (3, 12):  # twelve of these letters pass a number's 62 bits
        calls.clear()
        got = chem._gram_bits(pa.array(texts), np.array([len(t or "") for t in texts]), 64, n)
        want, grams = np.zeros(got.shape), set()
        for r, t in enumerate(texts):
            for g in {(t or "")[i:i + n] for i in range(len(t or "") - n + 1)}:
                want[r, int(md5(g.encode()).hexdigest()[:8], 16) % 64] = 1
                grams.add(g)
        assert (got == want).all() and len(calls) == len(grams)


def test_dose_functions(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.2, 0.0), (0.0, 0.0, 0.2, 1.0), (0.0, 1e-4, 0.2, 50.0)], "a double, b double, c double, x double")
    v = [r["v"] for r in df.select(dose.sig3upper(*map(F.col, "abcx")).alias("v")).collect()]
    assert v[0] == pytest.approx(0.6) and v[1] is None and v[2] == pytest.approx(1.0)
    d = spark.createDataFrame([(8.0,), (0.0,), (-1.0,)], "x double")
    assert [r["v"] for r in d.select(dose.log2_dose(F.col("x")).alias("v")).collect()] == [3.0, None, None]


def test_text_functions(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (" 2 ",), ("NaN",)], "s string")
    assert [r["v"] for r in df.select(text.to_numeric_or_null(F.col("s")).alias("v")).collect()] == [1.5, None, 2.0, None]
    raw = spark.createDataFrame([(bytearray(b"ab\xffc"),)], "b binary")
    assert raw.select(text.decode_text(F.col("b")).alias("t")).first()["t"] == "abc"
    j = spark.createDataFrame([(1, '{"a":{"b":1,"c":{"d":2}},"e":"text","f":3.5}')], "id int, j string")
    out = {r["metric"]: r["value"] for r in text.flatten_metrics(j, ["id"], "j", "_").collect()}
    assert out == {"a_b": 1.0, "a_c_d": 2.0, "f": 3.5}
    k = spark.createDataFrame([("Net_min_n_7_ULM",), ("bad",)], "k string")
    assert [tuple(r)[1:] for r in text.parse_run_key(k, "k").collect()] == [("net", 7, "ulm")]
    assert [r["min_n"] for r in text.parse_threshold(k, "k").collect()] == [7]


def test_few_strata_are_sent_to_the_rows(spark, capsys):
    rows = spark.range(400).select("id", (F.col("id") % 3).alias("run")).withColumn("_h", seeded_hash(1, "id"))
    hash_cuts(rows, "_h", lambda n: [n / 2], ["run"], few=True).explain()
    assert "SortMergeJoin" not in capsys.readouterr().out
    want, got = ({r.run: r.cuts for r in hash_cuts(rows, "_h", lambda n: [n / 2], ["run"], few=few).collect()} for few in (False, True))
    assert got == want and len(got) == 3
