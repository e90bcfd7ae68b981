"""Matching, lookup and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doselake.operators import joins as J
from doselake.operators import select as P
from doselake.operators import stats as A
from doselake.plans.catalog import query, r
from doselake.plans.screening import matched_dataset, matched_viability, viability_by_cell
from doselake.plans.standins import Tables


def _named(t: Tables) -> DataFrame:
    return J.lookup_chain(t.curves, t.per_experiment, t.per_cell_line, t.per_compound)


def _eligible_names(t: Tables) -> DataFrame:
    """Eligible signatures with what matching compares, and nothing else to be shuffled."""
    return P.filter_signatures(t.siginfo).select("sig_id", "cell_mfc_name", "pert_mfc_id", "cmap_name")


def _viability(t: Tables, combine: str = "mean") -> DataFrame:
    return matched_viability(
        t.siginfo, t.curves, t.per_experiment, t.per_cell_line, t.per_compound, combine
    )


@query("""
SELECT cell_mfc_name, round(avg(viability), 6) AS mean_viability, count(*) AS n_signatures,
       CAST(sum(CASE WHEN strategy = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_fallback
FROM sig_viability GROUP BY cell_mfc_name""")
def viability_per_cell(t: Tables) -> DataFrame:
    return viability_by_cell(_viability(t)).select(
        "cell_mfc_name", r("mean_viability"), "n_signatures", "n_fallback"
    )


@query("SELECT sig_id, strategy, round(viability, 6) AS viability, n_curves FROM sig_viability")
def signature_viability(t: Tables) -> DataFrame:
    return _viability(t).select("sig_id", "strategy", r("viability"), "n_curves")


@query("""
SELECT sig_id, experiment_id, master_cpd_id, round(greatest(0, least(1, v)), 6) AS viability FROM (
  SELECT *, row_number() OVER (PARTITION BY sig_id ORDER BY strategy, experiment_id, master_cpd_id) AS rn
  FROM evaluated) WHERE rn = 1""")
def first_curve(t: Tables) -> DataFrame:
    return _viability(t, "first").select("sig_id", "experiment_id", "master_cpd_id", r("viability"))


@query("""
WITH v AS (SELECT c.*, p.cpd_smiles FROM named_curves c JOIN per_compound p USING (master_cpd_id)
  WHERE len(p.cpd_smiles) >= 2 AND len(replace(p.cpd_smiles, '(', '')) = len(replace(p.cpd_smiles, ')', ''))
    AND len(replace(p.cpd_smiles, '[', '')) = len(replace(p.cpd_smiles, ']', '')) AND NOT contains(p.cpd_smiles, '1PS')),
a AS (SELECT s.sig_id, 1 AS strategy, s.pert_dose, v.*
  FROM eligible s JOIN v ON v.ccl_name = s.cell_mfc_name AND v.broad_cpd_id = s.pert_mfc_id),
b AS (SELECT s.sig_id, 2 AS strategy, s.pert_dose, v.*
  FROM eligible s JOIN v ON v.ccl_name = s.cell_mfc_name AND v.cpd_name = s.cmap_name
  WHERE s.sig_id NOT IN (SELECT sig_id FROM a)),
m AS (SELECT *, row_number() OVER (PARTITION BY sig_id ORDER BY strategy, experiment_id, master_cpd_id) AS rn,
  avg(p4_baseline + (1 - p4_baseline) / (1 + exp(greatest(-100, least(100, -(log2(pert_dose) - p1_center) / p2_slope)))))
    OVER (PARTITION BY sig_id) AS mean FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT m.sig_id, round(greatest(0, least(1, m.mean)), 6) AS viability, round(log2(m.pert_dose), 6) AS dose_log2,
  round(log2(l.c), 6) AS lowest_conc_log2, m.cpd_smiles
FROM m JOIN (SELECT experiment_id, master_cpd_id, min(cpd_conc_umol) AS c FROM concentrations GROUP BY 1, 2) l
  USING (experiment_id, master_cpd_id) WHERE rn = 1""")
def matched_data_set(t: Tables) -> DataFrame:
    d = matched_dataset(
        t.siginfo, t.curves, t.per_experiment, t.per_cell_line, t.per_compound, t.concentrations
    )
    return d.select("sig_id", r("viability"), r("dose_log2"), r("lowest_conc_log2"), "cpd_smiles")


@query("""
SELECT o.o_orderkey AS order_id, o.o_custkey AS pert_mfc_id, e.event_type, e.value
FROM orders o LEFT JOIN (
  SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) e
ON e.user_id = o.o_custkey AND e.rn = 1""")
def attach_compounds(t: Tables) -> DataFrame:
    rows = t.raw("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("pert_mfc_id"))
    info = t.raw("events").select(F.col("user_id").alias("pert_id"), "event_type", "value", "event_id")
    return J.attach_compounds(rows, info, ["event_id"]).drop("event_id")


@query("SELECT experiment_id, master_cpd_id, ccl_name, broad_cpd_id, cpd_name FROM named_curves")
def lookup_chain(t: Tables) -> DataFrame:
    return _named(t).select("experiment_id", "master_cpd_id", "ccl_name", "broad_cpd_id", "cpd_name")


@query("SELECT sig_id, experiment_id, master_cpd_id FROM match_a")
def match_pairs(t: Tables) -> DataFrame:
    return J.match_pairs(P.filter_signatures(t.siginfo), _named(t)).select(
        "sig_id", "experiment_id", "master_cpd_id"
    )


@query("SELECT sig_id, strategy, experiment_id, master_cpd_id FROM matched")
def match_with_fallback(t: Tables) -> DataFrame:
    return J.match_with_fallback(_eligible_names(t), _named(t)).select(
        "sig_id", "strategy", "experiment_id", "master_cpd_id"
    )


@query("""
SELECT m.sig_id, m.experiment_id, p.cpd_smiles FROM match_a m JOIN per_compound p USING (master_cpd_id)
WHERE len(p.cpd_smiles) >= 2 AND len(replace(p.cpd_smiles, '(', '')) = len(replace(p.cpd_smiles, ')', ''))
  AND len(replace(p.cpd_smiles, '[', '')) = len(replace(p.cpd_smiles, ']', ''))
  AND NOT contains(p.cpd_smiles, '1PS')""")
def attach_structure(t: Tables) -> DataFrame:
    pairs = J.match_pairs(P.filter_signatures(t.siginfo), _named(t))
    return J.attach_structure(pairs, t.per_compound).select("sig_id", "experiment_id", "cpd_smiles")


@query("""
SELECT o.rn AS list_pos, x.sig_id, x.pos, round(x.x, 6) AS x
FROM (SELECT vec_id AS sig_id, row_number() OVER (ORDER BY label, vec_id DESC) AS rn FROM embeddings WHERE label >= 5) o
JOIN expr x USING (sig_id)""")
def fetch_rows(t: Tables) -> DataFrame:
    from doselake.functions.ranking import global_row_number

    wanted = t.raw("embeddings").where("label >= 5").select(F.col("vec_id").alias("sig_id"), "label")
    ids = global_row_number(wanted, ["label", "sig_id"], "list_pos", {"sig_id"})
    rows = J.fetch_rows(t.matrix, ids)
    return rows.select("list_pos", "sig_id", F.posexplode("values").alias("pos", "x")).select(
        "list_pos", "sig_id", "pos", r("x")
    )


@query("""
SELECT c.experiment_id, c.master_cpd_id, c.cpd_conc_umol, p.cpd_name, e.master_ccl_id, l.ccl_name
FROM concentrations c LEFT JOIN per_compound p USING (master_cpd_id)
LEFT JOIN per_experiment e USING (experiment_id) LEFT JOIN per_cell_line l USING (master_ccl_id)""")
def left_merge(t: Tables) -> DataFrame:
    treated = J.left_merge(t.concentrations, t.per_compound, "master_cpd_id")
    cells = J.left_merge(t.per_experiment, t.per_cell_line, "master_ccl_id")
    return J.left_merge(treated, cells, "experiment_id").select(
        "experiment_id", "master_cpd_id", "cpd_conc_umol", "cpd_name", "master_ccl_id", "ccl_name"
    )


def _screen(t: Tables) -> DataFrame:
    treated = J.left_merge(t.concentrations, t.per_compound, "master_cpd_id")
    cells = J.left_merge(t.per_experiment, t.per_cell_line, "master_ccl_id")
    return P.rename_for_match(J.left_merge(treated, cells, "experiment_id"))


SCREEN = """
  SELECT c.cpd_conc_umol AS pert_dose, l.ccl_name AS cell_mfc_name, p.broad_cpd_id AS pert_mfc_id,
         c.cpd_pred_pv AS viability_score, c.experiment_id, c.master_cpd_id
  FROM concentrations c LEFT JOIN per_compound p USING (master_cpd_id)
  LEFT JOIN per_experiment e USING (experiment_id) LEFT JOIN per_cell_line l USING (master_ccl_id)"""


@query(f"""
SELECT s.sig_id, s.pert_dose, s.cell_mfc_name, s.pert_mfc_id, c.viability_score
FROM siginfo s JOIN ({SCREEN}) c USING (pert_dose, cell_mfc_name, pert_mfc_id)""")
def exact_triplet_match(t: Tables) -> DataFrame:
    return J.exact_triplet_match(t.siginfo, _screen(t)).select(
        "sig_id", "pert_dose", "cell_mfc_name", "pert_mfc_id", "viability_score"
    )


@query(f"""
SELECT experiment_id, master_cpd_id, cell_mfc_name, viability_score FROM ({SCREEN})
WHERE pert_mfc_id IN (SELECT pert_mfc_id FROM eligible) AND cell_mfc_name IN (SELECT cell_mfc_name FROM eligible)""")
def filter_to_known(t: Tables) -> DataFrame:
    kept = J.filter_to_known(_screen(t), P.filter_signatures(t.siginfo), ["pert_mfc_id", "cell_mfc_name"])
    return kept.select("experiment_id", "master_cpd_id", "cell_mfc_name", "viability_score")


@query("""
SELECT experiment_id, master_cpd_id, cpd_conc_umol, cpd_pred_pv FROM concentrations
JOIN (SELECT DISTINCT experiment_id, master_cpd_id FROM match_a) USING (experiment_id, master_cpd_id)""")
def lookup_measurements(t: Tables) -> DataFrame:
    pairs = J.match_pairs(P.filter_signatures(t.siginfo), _named(t))
    return J.lookup_measurements(pairs, t.concentrations)


@query("""
SELECT p.sig_id, p.prediction, s.cell_mfc_name, s.pert_dose
FROM predictions p JOIN siginfo s USING (sig_id)""")
def predictions_with_metadata(t: Tables) -> DataFrame:
    preds = t.predictions.select("sig_id", "prediction")
    return J.predictions_with_metadata(preds, t.siginfo, ["cell_mfc_name", "pert_dose"])


@query("""
WITH c AS (SELECT det_plate, sample_id AS control_id, row_number() OVER
             (PARTITION BY det_plate ORDER BY md5('42:' || sample_id), sample_id) AS no,
             count(*) OVER (PARTITION BY det_plate) AS n
           FROM samples WHERE pert_type = 'ctl_vehicle')
SELECT s.sample_id, s.det_plate, c.control_id FROM samples s JOIN c ON c.det_plate = s.det_plate
 AND c.no = CAST('0x' || substr(md5('43:' || s.sample_id), 1, 8) AS BIGINT) % c.n + 1
WHERE s.pert_type <> 'ctl_vehicle'""")
def pair_controls(t: Tables) -> DataFrame:
    return J.pair_controls(t.samples, F.col("pert_type") == "ctl_vehicle").select(
        "sample_id", "det_plate", "control_id"
    )


@query("""
SELECT pert_id, canonical_smiles, m.max_length FROM (
  SELECT source AS pert_id, text AS canonical_smiles,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) d,
  (SELECT least(max(len(text)), 128) AS max_length FROM (
     SELECT text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1) m
WHERE rn = 1""", ints=("max_length",))
def structure_dictionary(t: Tables) -> DataFrame:
    docs = t.raw("documents").select(
        F.col("source").alias("pert_id"), F.col("text").alias("canonical_smiles"), "doc_id"
    )
    d = J.structure_dictionary(docs, ["doc_id"])
    return d.withColumn("max_length", J.structure_length_limit(d, 128).scalar())


@query("""
SELECT source, target, weight FROM network WHERE target IN (SELECT gene_symbol FROM genes)""")
def shared_genes(t: Tables) -> DataFrame:
    edges, _ = J.shared_genes(t.network, t.genes)
    return edges.select("source", "target", "weight")


PAIRS_A = "SELECT ccl_name AS cell, broad_cpd_id AS cpd FROM named_curves"


@query(f"SELECT cell_mfc_name AS cell, pert_mfc_id AS cpd FROM eligible INTERSECT {PAIRS_A}")
def common_pairs(t: Tables) -> DataFrame:
    sig = P.filter_signatures(t.siginfo).select(F.col("cell_mfc_name").alias("cell"), F.col("pert_mfc_id").alias("cpd"))
    return J.common_pairs(sig, _named(t).select(F.col("ccl_name").alias("cell"), F.col("broad_cpd_id").alias("cpd")))


@query("""
SELECT sig_id, 'broad' AS method FROM eligible WHERE pert_mfc_id IN (SELECT broad_cpd_id FROM per_compound)
UNION ALL SELECT sig_id, 'name' FROM eligible WHERE cmap_name IN (SELECT cpd_name FROM per_compound)""")
def stack_results(t: Tables) -> DataFrame:
    e = P.filter_signatures(t.siginfo)
    a = e.join(t.per_compound.select(F.col("broad_cpd_id").alias("pert_mfc_id")).distinct(), "pert_mfc_id", "left_semi")
    b = e.join(t.per_compound.select(F.col("cpd_name").alias("cmap_name")).distinct(), "cmap_name", "left_semi")
    return J.stack_results({"broad": a.select("sig_id"), "name": b.select("sig_id")})


@query("""
SELECT sig_id, master_cpd_id FROM match_a UNION ALL SELECT sig_id, master_cpd_id FROM match_b""")
def stack_matches(t: Tables) -> DataFrame:
    # pairs are not stored: the strategies differ from the last shuffle on, what comes before is shared
    both = J.match_with_fallback(_eligible_names(t), _named(t)).select("strategy", "sig_id", "master_cpd_id")
    return J.stack_tables([both.where(F.col("strategy") == s).drop("strategy") for s in (1, 2)])


@query(f"""
SELECT cell_mfc_name AS cell, cmap_name AS cpd FROM eligible
EXCEPT SELECT ccl_name, cpd_name FROM named_curves""")
def uncovered_pairs(t: Tables) -> DataFrame:
    sig = P.filter_signatures(t.siginfo).select(F.col("cell_mfc_name").alias("cell"), F.col("cmap_name").alias("cpd"))
    return J.uncovered_pairs(sig, _named(t).select(F.col("ccl_name").alias("cell"), F.col("cpd_name").alias("cpd")))


@query("""
SELECT DISTINCT CASE feature_space WHEN 'inferred' THEN dup_symbol ELSE gene_symbol END AS node FROM genes
WHERE CASE feature_space WHEN 'inferred' THEN dup_symbol ELSE gene_symbol END NOT IN (
  SELECT child FROM (SELECT source AS parent, target AS child FROM network)
  WHERE child NOT IN (SELECT source FROM network))""")
def missing_genes(t: Tables) -> DataFrame:
    from doselake.operators.ontology import ontology_leaves

    edges = t.network.select(F.col("source").alias("parent"), F.col("target").alias("child"))
    name = F.when(F.col("feature_space") == "inferred", F.col("dup_symbol")).otherwise(F.col("gene_symbol"))
    return J.missing_genes(t.genes.select(name.alias("node")), ontology_leaves(edges))


@query("SELECT sig_id, round(avg(v), 6) AS viability, count(*) AS n_curves FROM evaluated GROUP BY sig_id")
def mean_viability(t: Tables) -> DataFrame:
    means = J.signature_viability(P.filter_signatures(t.siginfo), _named(t), clip=False)
    return means.select("sig_id", r("viability"), "n_curves")


@query("""
SELECT c.experiment_id, c.master_cpd_id, round(log2(m.c), 6) AS lowest_conc_log2 FROM curves c
LEFT JOIN (SELECT experiment_id, master_cpd_id, min(cpd_conc_umol) AS c FROM concentrations GROUP BY 1, 2) m
USING (experiment_id, master_cpd_id)""")
def min_concentration(t: Tables) -> DataFrame:
    return A.min_concentration(t.curves, t.concentrations).select(
        "experiment_id", "master_cpd_id", r("lowest_conc_log2")
    )


@query("""
SELECT count(DISTINCT m.sig_id) AS n_matched, count(DISTINCT p.cpd_smiles) AS n_compounds,
       (SELECT count(DISTINCT sig_id) FROM eligible) AS n_eligible,
       round(count(DISTINCT m.sig_id)::DOUBLE / (SELECT count(DISTINCT sig_id) FROM eligible), 6) AS coverage
FROM matched m JOIN per_compound p USING (master_cpd_id)""")
def match_summary(t: Tables) -> DataFrame:
    e = P.filter_signatures(t.siginfo)
    signatures, curves = J.matched_sides(e, _named(t))
    compounds = curves.join(t.per_compound.select("master_cpd_id", "cpd_smiles"), "master_cpd_id")
    return A.match_summary(signatures, e, compounds=compounds).select("n_matched", "n_compounds", "n_eligible", r("coverage"))
