"""Sources and sinks: written to the shared folder, read back, and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doselake import schema as S
from doselake.functions.ranking import global_row_number
from doselake.functions.skew import narrowed
from doselake.operators import joins as J
from doselake.operators import select as P
from doselake.operators import stats as A
from doselake.plans.catalog import cells, query, r
from doselake.plans.standins import Tables
from doselake.session import scratch_path, stored
from doselake.sources import matrix_store as MS
from doselake.sources import flat, sinks, tables


@query("SELECT sig_id, cell_mfc_name, pert_mfc_id, cmap_name, pert_dose, pert_time FROM siginfo")
def read_tsv(t: Tables) -> DataFrame:
    path = sinks.write_csv(t.siginfo, scratch_path(t.spark, "siginfo"), sep="\t")
    return tables.read_tsv(t.spark, path, S.SIGINFO.replace("sig_id STRING", "sig_id BIGINT"))


@query("SELECT sig_id, cell_mfc_name, pert_dose FROM siginfo")
def require_columns(t: Tables) -> DataFrame:
    wanted = ["sig_id", "cell_mfc_name", "pert_dose"]
    return S.require_columns(t.siginfo, wanted, what="siginfo").select(*wanted)


@query("SELECT l_orderkey, l_extendedprice FROM lineitem")
def read_csv(t: Tables) -> DataFrame:
    cols = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    path = sinks.write_csv(cols, scratch_path(t.spark, "lines"))
    ddl = "l_orderkey BIGINT, l_linenumber INT, l_extendedprice DOUBLE, l_returnflag STRING"
    return tables.read_csv(t.spark, path, ddl, ["l_orderkey", "l_extendedprice"])


@query("""
SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) AS rn FROM orders)
WHERE rn <= 1000""")
def read_csv_sampled(t: Tables) -> DataFrame:
    path = sinks.write_csv(t.raw("orders").select("o_orderkey", "o_totalprice"), scratch_path(t.spark, "orders"))
    return tables.read_csv_sampled(t.spark, path, "o_orderkey BIGINT, o_totalprice DOUBLE", 1000, use_chunks=True)


@query("SELECT experiment_id, master_cpd_id, cpd_conc_umol, cpd_pred_pv FROM concentrations")
def write_csv(t: Tables) -> DataFrame:
    path = sinks.write_csv(t.concentrations, scratch_path(t.spark, "conc"))
    ddl = "experiment_id BIGINT, master_cpd_id BIGINT, cpd_conc_umol DOUBLE, cpd_pred_pv DOUBLE"
    return tables.read_csv(t.spark, path, ddl)


def _container(t: Tables) -> str:
    path = scratch_path(t.spark, "matrix")
    rows = t.matrix.select("row_no", "sig_id").join(t.rowmeta, "sig_id")
    return MS.write_matrix(t.matrix, rows, t.genes, {"version": "1.0", "platform": "test"}, path)


@query("SELECT sig_id, pos, round(x, 6) AS x FROM expr")
def write_matrix(t: Tables) -> DataFrame:
    return cells(MS.read_matrix(t.spark, _container(t)))


@query("""
SELECT e.sig_id, row_number() OVER (PARTITION BY e.sig_id ORDER BY e.pos) - 1 AS pos, round(e.x, 6) AS x
FROM expr e JOIN genes g USING (pos) WHERE g.feature_space = 'landmark' AND e.sig_id >= 20 AND e.sig_id < 220 AND e.sig_id % 2 = 0""", ints=("pos",))
def read_matrix(t: Tables) -> DataFrame:
    return cells(MS.read_matrix(t.spark, _container(t), slice(20, 220, 2), feature_space="landmark"))


@query("""
SELECT n.row_no, g.sig_id, g.pos, round(g.x, 6) AS x FROM gaps g
JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_no FROM embeddings) n ON n.vec_id = g.sig_id
WHERE g.x IS NOT NULL""")
def read_binary_matrix(t: Tables) -> DataFrame:
    """The matrix with gaps as a flat file and back; ids come from a table of row numbers."""
    size = t.gappy.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("values")).alias("cols")).first()
    path = flat.write_flat_matrix(t.gappy, scratch_path(t.spark, "flat"), size.cols, dtype="float32")
    ids = global_row_number(t.gappy.select("sig_id"), ["sig_id"], "row_no").withColumn("row_no", F.col("row_no") - 1)
    back = tables.read_binary_matrix(t.spark, path, size.rows, size.cols, "float32", row_ids=ids)
    long = back.select("row_no", "sig_id", F.posexplode_outer("values").alias("pos", "x")).where("x IS NOT NULL")
    return long.select("row_no", "sig_id", "pos", r("x"))


@query("SELECT sig_id, cell_mfc_name, pert_dose FROM rowmeta WHERE sig_id >= 5")
def read_row_metadata(t: Tables) -> DataFrame:
    return MS.read_row_metadata(t.spark, _container(t), ["sig_id", "cell_mfc_name", "pert_dose"], slice(5, None))


@query("SELECT gene_id, gene_symbol FROM genes WHERE feature_space IN ('landmark', 'inferred')")
def read_gene_metadata(t: Tables) -> DataFrame:
    return MS.read_gene_metadata(t.spark, _container(t), ["gene_id", "gene_symbol"], feature_space=["landmark", "inferred"])


@query("""
SELECT 'platform' AS key, 'test' AS value, count(*) AS n_rows FROM embeddings
UNION ALL SELECT 'version', '1.0', count(*) FROM embeddings""")
def read_attributes(t: Tables) -> DataFrame:
    path = _container(t)
    n = t.spark.read.parquet(f"{path}/matrix").agg(F.count(F.lit(1)))
    return MS.read_attributes(t.spark, path).select(F.explode("attributes").alias("key", "value")).withColumn(
        "n_rows", n.scalar())


@query("""
SELECT e.sig_id, m.cell_mfc_name, count(*) AS n_genes, round(sum(e.x), 6) AS total
FROM expr e JOIN genes g USING (pos) JOIN rowmeta m USING (sig_id)
WHERE g.feature_space = 'best inferred' GROUP BY 1, 2""")
def read_data_with_metadata(t: Tables) -> DataFrame:
    data, _ = MS.read_data_with_metadata(t.spark, _container(t), feature_space="best inferred")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return data.select("sig_id", "cell_mfc_name", F.size("values").cast("bigint").alias("n_genes"), r(total).alias("total"))


@query("""
SELECT c AS "check", e AS expected, a AS actual, 1 AS ok FROM (
  SELECT 'rows_match_ids' AS c, CAST(count(*) AS VARCHAR) AS e, CAST(count(*) AS VARCHAR) AS a FROM embeddings
  UNION ALL SELECT 'narrowest_row_matches_genes', CAST((SELECT count(*) FROM genes) AS VARCHAR), CAST(min(len(embedding)) AS VARCHAR) FROM embeddings
  UNION ALL SELECT 'widest_row_matches_genes', CAST((SELECT count(*) FROM genes) AS VARCHAR), CAST(max(len(embedding)) AS VARCHAR) FROM embeddings
  UNION ALL SELECT 'value_type', 'array<float>', 'array<float>')""")
def validate_container(t: Tables) -> DataFrame:
    return MS.validate_container(t.spark, _container(t))


@query("""
SELECT grp, metric, round(value, 4) AS value FROM (
  SELECT grp, avg((target - prediction) * (target - prediction)) AS mse, avg(abs(target - prediction)) AS mae
  FROM predictions GROUP BY grp) UNPIVOT (value FOR metric IN (mse, mae))""")
def write_metrics_json(t: Tables) -> DataFrame:
    m = A.regression_metrics(t.predictions, ["grp"], ["mse", "mae"]).unpivot(["grp"], ["mse", "mae"], "metric", "value")
    path = sinks.write_metrics_json(m, scratch_path(t.spark, "metrics"))
    back = t.spark.read.schema("grp STRING, metric STRING, value DOUBLE").json(path)
    return back.select("grp", "metric", r("value", 4))


@query("SELECT sig_id, grp, run, round(prediction, 6) AS prediction FROM predictions")
def write_predictions(t: Tables) -> DataFrame:
    path = sinks.write_predictions(
        t.predictions.select("sig_id", "grp", "run", "prediction"), scratch_path(t.spark, "preds"), run="run")
    return t.spark.read.parquet(path).select("sig_id", "grp", "run", r("prediction"))


@query("SELECT 'v1' AS version, 'cells' AS name, count(*) AS n FROM nation UNION ALL SELECT 'v1', 'curves', count(*) FROM curves UNION ALL SELECT 'v2', 'cells', count(*) FROM region")
def list_versions(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "versions")
    sinks.save_version(t.raw("nation"), base, "cells", "v1", {"source": "nation"})
    sinks.save_version(t.curves, base, "curves", "v1")
    sinks.save_version(t.raw("region"), base, "cells", "v2")
    out = None
    listed = sinks.list_versions(t.spark, base).select("version", F.explode("names").alias("name"))
    for row in listed.orderBy("version", "name").collect():
        n = sinks.load_version(t.spark, base, row["name"], row["version"])[0].agg(F.count(F.lit(1)).alias("n"))
        one = n.select(F.lit(row["version"]).alias("version"), F.lit(row["name"]).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT parent, child, relationship FROM ontology")
def read_edges(t: Tables) -> DataFrame:
    path = sinks.write_csv(t.ontology, scratch_path(t.spark, "ontology"), sep="\t", header=False)
    return tables.read_edges(t.spark, path, "ontology")


@query("SELECT source, target, weight FROM network")
def read_network(t: Tables) -> DataFrame:
    path = sinks.write_csv(t.network.select("source", "target", "weight"), scratch_path(t.spark, "network"), sep="\t")
    return tables.read_edges(t.spark, path)


@query("SELECT row_number() OVER (ORDER BY name) - 1 AS index, name FROM (SELECT DISTINCT p_brand AS name FROM part)")
def write_index_file(t: Tables) -> DataFrame:
    path = sinks.write_index_file(t.raw("part"), "p_brand", scratch_path(t.spark, "index"))
    return tables.read_tsv(t.spark, path, "index BIGINT, name STRING", header=False)


@query("SELECT sig_id, strategy, experiment_id, master_cpd_id FROM matched")
def resume_match(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "resume")
    # both runs read these, and a run reads the curves twice
    named = stored(J.lookup_chain(t.curves, t.per_experiment, t.per_cell_line, t.per_compound), "resume-curves")
    wanted = P.filter_signatures(t.siginfo).select("sig_id", "cell_mfc_name", "pert_mfc_id", "cmap_name")
    wanted = stored(wanted, "resume-signatures")

    def match(todo: DataFrame) -> sinks.Factored:
        curves = narrowed(named, todo.select(F.col("cell_mfc_name").alias("ccl_name")), ["ccl_name"])
        signatures, curves = J.fallback_sides(todo, curves)
        return sinks.Factored(
            signatures.select("sig_id", *J.MATCH_KEYS),
            curves.select(*J.MATCH_KEYS, "experiment_id", "master_cpd_id"), J.MATCH_KEYS)

    sinks.resume_match(wanted.where("cell_mfc_name < 'NATION_2'"), match, path, buckets=8)  # a first run that ends early
    matched = sinks.resume_match(wanted, match, path, buckets=8)
    return matched.select("sig_id", "strategy", "experiment_id", "master_cpd_id")
