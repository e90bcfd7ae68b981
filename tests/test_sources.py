"""Readers, writers, containers, and their error paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from doselake import schema as S
from doselake.functions import skew
from doselake.sources import flat, sinks, tables
from doselake.sources import matrix_store as MS


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,value\n" + "\n".join(f"{i},{i * 10}" for i in range(100)))
    return str(path)


DDL = "id INT, value INT"


def test_sampled_csv(spark, csv_file):
    assert tables.read_csv_sampled(spark, csv_file, DDL).count() == 100
    assert tables.read_csv_sampled(spark, csv_file, DDL, 10).count() == 10
    drawn = tables.read_csv_sampled(spark, csv_file, DDL, 10, use_chunks=True, chunk_size=20)
    assert drawn.count() == 10 and drawn.where("value = id * 10").count() == 10
    assert tables.read_csv_sampled(spark, csv_file, DDL, 1000, use_chunks=True).count() == 100
    with pytest.raises(ValueError):
        tables.read_csv_sampled(spark, csv_file, DDL, -5)
    with pytest.raises(ValueError):
        tables.read_csv_sampled(spark, csv_file, DDL, 10, chunk_size=-10)
    with pytest.raises(FileNotFoundError):
        tables.read_csv_sampled(spark, "/no/such/file.csv", DDL)


def test_binary_matrix(spark, tmp_path):
    data = np.arange(20, dtype="float64").reshape(5, 4)
    data[2, 1] = np.nan
    path = str(tmp_path / "rna.bin")
    data.tofile(path)
    rows = tables.read_binary_matrix(spark, path, 5, 4).orderBy("row_no").collect()
    assert [r["row_no"] for r in rows] == list(range(5))
    assert rows[2]["values"] == [8.0, None, 10.0, 11.0]
    f32 = str(tmp_path / "rna32.bin")
    data.astype("float32").tofile(f32)
    assert tables.read_binary_matrix(spark, f32, 5, 4, dtype="float32").count() == 5
    with pytest.raises(ValueError):
        tables.read_binary_matrix(spark, path, 5, 4, n_genes=5)
    with pytest.raises(ValueError):
        tables.read_binary_matrix(spark, path, 6, 4)
    ids = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "row_no bigint, sig_id string")
    assert tables.read_binary_matrix(spark, path, 5, 4, row_ids=ids).where("sig_id = 's3'").count() == 1
    with pytest.raises(ValueError):
        tables.read_binary_matrix(spark, path, 5, 4, row_ids=ids.limit(4))


def test_flat_matrix_parts_and_ranges(spark, tmp_path, monkeypatch):
    """Many parts and ranges give the rows in order; a broken or wrong file is an error."""
    rng = np.random.default_rng(1)
    data = rng.standard_normal((503, 7)).astype("float32")
    data[3, 2] = np.nan
    rows = [(i, [None if np.isnan(x) else float(x) for x in r]) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "row_no bigint, values array<float>").withColumn("more", F.lit("x")).repartition(5)
    path = flat.write_flat_matrix(df, str(tmp_path / "m"), 7)
    assert flat.read_flat_matrix(spark, path, 503, 7).count() == 503
    dealt = df.repartitionByRange(4, "row_no").sortWithinPartitions("row_no")
    dealt.write.format("flat_matrix").option("cols", 7).mode("overwrite").save(path)
    back = flat.read_flat_matrix(spark, path, 503, 7).orderBy("row_no").collect()
    assert [r.row_no for r in back] == list(range(503))
    assert np.array_equal(np.array([r["values"] for r in back], "float32"), data, equal_nan=True)
    parts = flat.Shape(path, 7, "<f8", 503).parts()
    assert len(parts) > 1 and sum(n for _, n in parts) == 503
    monkeypatch.setattr(flat, "RANGE", 10 * 56)
    ranges = flat.Reader(flat.Shape(path, 7, "<f8", None)).partitions()
    assert [r.first for r in ranges] == np.cumsum([0, *[r.rows for r in ranges]])[:-1].tolist() and max(r.rows for r in ranges) == 10
    got = np.concatenate([np.array(b.column(1).to_pylist(), "float32") for r in ranges for b in flat.Reader(flat.Shape(path, 7, "<f8", None)).read(r)])
    assert np.array_equal(got, data, equal_nan=True)
    # a second write appends, an overwrite replaces
    spark.createDataFrame([([1.0] * 7,)], "values array<double>").write.format("flat_matrix").option("cols", 7).mode("append").save(path)
    assert flat.read_flat_matrix(spark, path, 504, 7).count() == 504
    flat.write_flat_matrix(df.limit(2), path, 7)
    assert flat.read_flat_matrix(spark, path, None, 7).count() == 2
    flat.write_flat_matrix(df.limit(0), path, 7)
    assert flat.read_flat_matrix(spark, path, 0, 7).count() == 0
    for shape in ((503, 6), (502, 7), (None, 1000)):
        with pytest.raises(ValueError):
            flat.read_flat_matrix(spark, flat.write_flat_matrix(df, path, 7), *shape)
    with pytest.raises(Exception, match="does not have 6 values"):
        flat.write_flat_matrix(df, str(tmp_path / "wrong"), 6)
    with pytest.raises(FileNotFoundError):  # the broken write named no parts
        flat.read_flat_matrix(spark, str(tmp_path / "wrong"), None, 6)


@pytest.fixture
def container(spark, tmp_path):
    m = spark.createDataFrame([(i, f"s{i}", [float(i * 10 + j) for j in range(4)]) for i in range(6)],
                              "row_no bigint, sig_id string, values array<double>")
    genes = spark.createDataFrame(
        [(0, "A", "landmark"), (1, "B", "best inferred"), (2, "C", "other"), (3, "D", "landmark")],
        "pos int, gene_symbol string, feature_space string")
    rows = m.select("row_no", "sig_id").withColumn("cell", F.lit("x"))
    return MS.write_matrix(m, rows, genes, {"version": "2"}, str(tmp_path / "c"))


def test_container(spark, container):
    assert MS.read_matrix(spark, container).schema["values"].dataType.simpleString() == "array<float>"
    got = MS.read_matrix(spark, container, [4, 1, 4], genes=[3, 0]).orderBy("list_pos").collect()
    assert [(r["row_no"], r["values"]) for r in got] == [(4, [43.0, 40.0]), (1, [13.0, 10.0]), (4, [43.0, 40.0])]
    part = MS.read_matrix(spark, container, slice(1, 6, 2), genes=slice(1, 3)).orderBy("row_no").collect()
    assert [r["values"] for r in part] == [[11.0, 12.0], [31.0, 32.0], [51.0, 52.0]]
    assert MS.read_matrix(spark, container, feature_space="landmark").orderBy("row_no").first()["values"] == [0.0, 3.0]
    assert MS.read_row_metadata(spark, container, "cell", [2]).columns == ["cell", "list_pos"]
    assert MS.read_gene_metadata(spark, container, ["gene_symbol"], genes=[1, 2]).count() == 2
    assert MS.read_attributes(spark, container).first()["attributes"] == {"version": "2"}
    assert {r["ok"] for r in MS.validate_container(spark, container).collect()} == {1}
    data, genes = MS.read_data_with_metadata(spark, container, feature_space="landmark")
    assert data.count() == 6 and genes.count() == 2


def test_container_errors(spark, container):
    with pytest.raises(IndexError):
        MS.read_matrix(spark, container, [6])
    with pytest.raises(IndexError):
        MS.read_matrix(spark, container, genes=[4])
    with pytest.raises(ValueError):
        MS.read_matrix(spark, container, genes=[0], feature_space="landmark")
    with pytest.raises(ValueError):
        MS.read_matrix(spark, container, feature_space="unknown")
    with pytest.raises(ValueError):
        MS.read_matrix(spark, container, feature_space="inferred")  # no such gene stored
    with pytest.raises(KeyError):
        MS.read_row_metadata(spark, container, ["nope"])


def test_validate_finds_ragged_rows(spark, tmp_path):
    m = spark.createDataFrame([(0, "a", [1.0, 2.0]), (1, "b", [1.0])], "row_no bigint, sig_id string, values array<double>")
    genes = spark.createDataFrame([(0,), (1,)], "pos int")
    path = MS.write_matrix(m, m.select("row_no", "sig_id"), genes, {}, str(tmp_path / "r"))
    bad = [r["check"] for r in MS.validate_container(spark, path).where("ok = 0").collect()]
    assert bad == ["narrowest_row_matches_genes"]


def test_csv_is_not_overwritten(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("col1"), (F.col("id") + 10).alias("col2"))
    path = sinks.write_csv(df.repartition(3), str(tmp_path / "out"))
    back = tables.read_csv(spark, path, "col1 BIGINT, col2 BIGINT")
    assert sorted(map(tuple, back.collect())) == [(i, i + 10) for i in range(10)]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_csv(back, path)


def test_versions(spark, tmp_path):
    base = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        sinks.load_version(spark, base, "a")
    sinks.save_version(spark.range(3).toDF("x"), base, "a", "v1", {"note": "first"})
    sinks.save_version(spark.range(4).toDF("x"), base, "b", "v1")
    df, record = sinks.load_version(spark, base, "a")
    row = record.first()
    assert df.count() == 3 and row["metadata"] == {"note": "first"} and row["size_bytes"] > 0
    assert sinks.list_versions(spark, base).first()["names"] == ["a", "b"]
    assert sinks.list_versions(spark, base, "b").first()["names"] == ["b"]
    with pytest.raises(FileNotFoundError):
        sinks.load_version(spark, base, "a", "v9")


def test_edges_and_index(spark, tmp_path):
    bad = tmp_path / "net.tsv"
    bad.write_text("source\ttarget\nA\tB\n")
    with pytest.raises(ValueError):
        tables.read_edges(spark, str(bad))
    names = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "n string")
    path = sinks.write_index_file(names, "n", str(tmp_path / "idx"))
    back = tables.read_tsv(spark, path, "i BIGINT, n STRING", header=False).orderBy("i").collect()
    assert [tuple(r) for r in back] == [(0, "a"), (1, "b"), (2, "c")]


def test_resume_skips_what_is_done(spark, tmp_path):
    path, calls = str(tmp_path / "m"), []

    def match(todo):
        calls.append(todo.count())
        return todo.where("sig_id <> 2")  # one finds no match

    sigs = spark.range(10).select(F.col("id").alias("sig_id"))
    sinks.resume_match(sigs.where("sig_id < 4"), match, path, buckets=2)
    out = sinks.resume_match(sigs, match, path, buckets=2)
    assert calls == [4, 6]
    assert sorted(r["sig_id"] for r in out.collect()) == [i for i in range(10) if i != 2]
    # matches of a run that broke off before it noted them are not returned
    sigs.limit(1).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(path + "/matches/run=broken")
    assert sinks.resume_match(sigs, match, path, buckets=2).count() == 9 and calls[2] == 0


def test_resume_stores_the_sides_of_many_pairs(spark, tmp_path):
    path = str(tmp_path / "f")
    sigs = spark.range(40).select(F.col("id").alias("sig_id"))
    curves = spark.range(200).select((F.col("id") % 2).alias("k"), F.col("id").alias("curve"))

    def match(todo):
        return sinks.Factored(todo.select("sig_id", (F.col("sig_id") % 4).alias("k")), curves, ["k"])

    sinks.resume_match(sigs.where("sig_id < 10 AND sig_id % 4 <> 1"), match, path, buckets=2)
    out = sinks.resume_match(sigs, match, path, buckets=2)
    want = {(s, c) for s in range(40) for c in range(200) if s % 4 == c % 2}
    got = [(r["sig_id"], r["curve"]) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    # 2,000 pairs are stored as one row a signature, and each run's curves of the keys it used
    assert spark.read.parquet(path + "/matches").count() == 40
    assert spark.read.parquet(path + "/partners").groupBy("run").count().count() == 2
    assert spark.read.parquet(path + "/partners").count() == 100 + 200


def test_resume_works_its_signatures_out_once_a_run(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counting(x):
        seen.add(1)
        return x

    path = str(tmp_path / "o")
    counted = F.udf(counting, "bigint").asNondeterministic()  # filters are not put in front of it
    sigs = spark.range(40).select(counted("id").alias("sig_id"))
    curves = spark.range(200).select((F.col("id") % 2).alias("k"), F.col("id").alias("curve"))

    def match(todo):
        return sinks.Factored(todo.select("sig_id", (F.col("sig_id") % 4).alias("k")), curves, ["k"])

    out = sinks.resume_match(sigs, match, path, buckets=2)
    assert out.count() == 2000 and seen.value == 40


def test_narrowed_keeps_what_can_meet(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 11), (3, None, 10), (4, "a", 12), (5, "a", None)], "id int, c string, k int")
    by = spark.createDataFrame([("a", 10), ("a", 11), (None, 12), ("a", 11)], "c string, k int")
    ids = lambda x: sorted(r["id"] for r in x.collect())
    out = skew.narrowed(df, by, ["c", "k"])
    assert out.columns == df.columns and ids(out) == [1, 4]
    assert ids(skew.narrowed(df, by.limit(0), ["c"])) == []
    monkeypatch.setattr(skew, "MOST_VALUES", 1)  # k has more values than are broadcast
    assert ids(skew.narrowed(df, by, ["c", "k"])) == [1, 4, 5]


def test_require_columns(spark):
    with pytest.raises(KeyError):
        S.require_columns(spark.range(1), ["x"])
    with pytest.raises(ValueError):
        S.require_columns(spark.range(1), ["x"], ValueError)
