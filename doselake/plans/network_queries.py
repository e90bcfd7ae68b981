"""Network and ontology queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doselake.operators import network as G
from doselake.operators import ontology as O
from doselake.plans.catalog import query, r
from doselake.plans.standins import Tables


@query("""
WITH e AS (SELECT n.source, g.pos, sum(n.weight) AS w FROM network n JOIN genes g ON g.gene_symbol = n.target GROUP BY 1, 2),
u AS (SELECT DISTINCT pos FROM e),
k AS (SELECT source, sum(w) AS sw, sum(w * w) AS sww FROM e GROUP BY 1 HAVING count(*) >= 5),
x AS (SELECT sig_id, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx FROM expr JOIN u USING (pos) GROUP BY 1),
d AS (SELECT sig_id, source, sum(x * w) AS swx FROM expr JOIN e USING (pos) GROUP BY 1, 2),
rr AS (SELECT d.sig_id, d.source, n, (n * swx - sw * sx) / (sqrt(n * sww - sw * sw) * sqrt(n * sxx - sx * sx)) AS r
  FROM d JOIN k USING (source) JOIN x USING (sig_id))
SELECT sig_id, source, m.cell_mfc_name, round(r * sqrt((n - 2) / ((1 - r) * (1 + r))), 5) AS activity
FROM rr JOIN rowmeta m USING (sig_id)""")
def tf_activity_ulm(t: Tables) -> DataFrame:
    rows = t.matrix.join(t.rowmeta, "sig_id")
    return G.tf_activity_ulm(rows, t.genes, t.network, min_n=5).select("sig_id", "source", "cell_mfc_name", r("activity", 5))


# A gene missing in a row is left out of that row's regressions.
@query("""
WITH e AS (SELECT n.source, g.pos, sum(n.weight) AS w FROM network n JOIN genes g ON g.gene_symbol = n.target GROUP BY 1, 2),
u AS (SELECT DISTINCT pos FROM e),
k AS (SELECT source FROM e GROUP BY 1 HAVING count(*) >= 5),
x AS (SELECT sig_id, count(x)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx FROM gaps JOIN u USING (pos) GROUP BY 1),
d AS (SELECT sig_id, source, sum(x * w) AS swx, sum(w) FILTER (x IS NOT NULL) AS sw, sum(w * w) FILTER (x IS NOT NULL) AS sww
  FROM gaps JOIN e USING (pos) JOIN k USING (source) GROUP BY 1, 2),
rr AS (SELECT sig_id, source, n, (n * swx - sw * sx) / (sqrt(n * sww - sw * sw) * sqrt(n * sxx - sx * sx)) AS r
  FROM d JOIN x USING (sig_id))
SELECT sig_id, source, round(r * sqrt((n - 2) / ((1 - r) * (1 + r))), 5) AS activity FROM rr""")
def tf_activity_ulm_gaps(t: Tables) -> DataFrame:
    return G.tf_activity_ulm(t.gappy, t.genes, t.network, min_n=5, metadata=()).select("sig_id", "source", r("activity", 5))


@query()
def tf_activity_mlm(t: Tables) -> DataFrame:
    return G.tf_activity_mlm(t.matrix, t.genes, t.network).select("sig_id", "source", r("activity", 5))


# Two factors in closed form: centred cross products of both weights and the row, over the genes the row has.
@query("""
WITH e AS (SELECT n.source, g.pos, sum(n.weight) AS w FROM network n JOIN genes g ON g.gene_symbol = n.target
  WHERE n.source IN ('TF1', 'TF2') GROUP BY 1, 2),
d AS (SELECT pos, coalesce(sum(w) FILTER (source = 'TF1'), 0) AS a, coalesce(sum(w) FILTER (source = 'TF2'), 0) AS b FROM e GROUP BY pos),
c AS (SELECT sig_id, count(x)::DOUBLE AS n, var_pop(a) * n AS aa, var_pop(b) * n AS bb, covar_pop(a, b) * n AS ab,
  covar_pop(a, x) * n AS ax, covar_pop(b, x) * n AS bx, var_pop(x) * n AS xx FROM gaps JOIN d USING (pos) WHERE x IS NOT NULL GROUP BY 1),
f AS (SELECT *, aa * bb - ab * ab AS det, (bb * ax - ab * bx) / det AS p, (aa * bx - ab * ax) / det AS q,
  (xx - p * ax - q * bx) / (n - 3) AS s2 FROM c)
SELECT sig_id, 'TF1' AS source, round(p / sqrt(s2 * bb / det), 5) AS activity FROM f
UNION ALL SELECT sig_id, 'TF2', round(q / sqrt(s2 * aa / det), 5) FROM f""")
def tf_activity_mlm_pair(t: Tables) -> DataFrame:
    pair = t.network.where(F.col("source").isin("TF1", "TF2"))
    return G.tf_activity_mlm(t.gappy, t.genes, pair).select("sig_id", "source", r("activity", 5))


@query("SELECT source, target, weight FROM network WHERE source IN (SELECT source FROM network GROUP BY 1 HAVING count(*) >= 18)")
def min_targets(t: Tables) -> DataFrame:
    return G.min_targets(t.network, 18).select("source", "target", "weight")


@query("""
SELECT CAST(n AS INTEGER) AS min_n, count(*) AS n_sources, CAST(sum(k) AS BIGINT) AS n_edges
FROM (SELECT source, count(*) AS k FROM network GROUP BY 1) JOIN (SELECT unnest(range(1, 21)) AS n) ON k >= n GROUP BY n""")
def min_targets_sweep(t: Tables) -> DataFrame:
    return G.min_targets_sweep(t.network, 20)


@query("""
WITH tf AS (SELECT DISTINCT source FROM network), g AS (SELECT DISTINCT target FROM network),
w AS (SELECT target, source, arg_max(weight, row_no) AS weight FROM network GROUP BY 1, 2)
SELECT g.target, tf.source, coalesce(w.weight, 0) AS weight FROM g CROSS JOIN tf LEFT JOIN w ON w.target = g.target AND w.source = tf.source""")
def gene_tf_matrix(t: Tables) -> DataFrame:
    grid = G.gene_tf_matrix(t.network)
    return grid.unpivot(["target"], [c for c in grid.columns if c != "target"], "source", "weight")


@query("""
WITH tf AS (SELECT DISTINCT source FROM network), g AS (SELECT DISTINCT target FROM network),
w AS (SELECT target, source, arg_max(weight, row_no) AS weight FROM network GROUP BY 1, 2)
SELECT g.target, tf.source, coalesce(w.weight, 0) AS weight FROM g CROSS JOIN tf LEFT JOIN w ON w.target = g.target AND w.source = tf.source""")
def gene_tf_rows(t: Tables) -> DataFrame:
    rows, factors = G.gene_tf_rows(t.network)
    return rows.select("target", F.posexplode("weights").alias("place", "weight")).join(factors, "place").drop("place")


@query("""
SELECT side, count(*) AS n_nodes, CAST(sum(d) AS BIGINT) AS n_edges, max(d) AS max_degree,
  round(avg(CASE WHEN d < 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_below FROM (
  SELECT 'source' AS side, source AS node, count(*) AS d FROM network GROUP BY 2
  UNION ALL SELECT 'target', target, count(*) FROM network GROUP BY 2) GROUP BY side""")
def degree_distribution(t: Tables) -> DataFrame:
    return G.degree_distribution(t.network).select("side", "n_nodes", "n_edges", "max_degree", r("share_below"))


@query("SELECT parent AS node, d AS degree, row_number() OVER (ORDER BY d DESC, parent) AS rank FROM (SELECT parent, count(*) AS d FROM ontology GROUP BY 1)")
def degree_rank(t: Tables) -> DataFrame:
    return G.degree_rank(t.ontology, "parent").select("node", "degree", "rank")


@query("SELECT DISTINCT child AS node FROM ontology WHERE child NOT IN (SELECT parent FROM ontology)")
def ontology_leaves(t: Tables) -> DataFrame:
    return O.ontology_leaves(t.ontology)


@query("""
SELECT (SELECT count(*) FROM (SELECT parent FROM ontology UNION SELECT child FROM ontology)) AS n_nodes,
  (SELECT count(*) FROM (SELECT DISTINCT parent, child FROM ontology)) AS n_edges,
  (SELECT count(DISTINCT child) FROM ontology WHERE child NOT IN (SELECT parent FROM ontology)) AS n_leaves""")
def ontology_summary(t: Tables) -> DataFrame:
    return O.ontology_summary(t.ontology)


BELOW = """
WITH RECURSIVE b AS (
  SELECT o.parent AS term, k.node AS gene FROM ontology o JOIN known_genes k ON k.node = o.child
  UNION SELECT o.parent, b.gene FROM b JOIN ontology o ON o.child = b.term)"""


@query(BELOW + """
SELECT parent, child, relationship FROM ontology WHERE child IN (SELECT node FROM known_genes) OR child IN (SELECT term FROM b)""")
def filter_ontology(t: Tables) -> DataFrame:
    return O.filter_ontology(t.ontology, t.known_genes)


@query(BELOW + """
SELECT n.node, coalesce(c.n, 0) AS n_genes FROM (SELECT parent AS node FROM ontology UNION SELECT child FROM ontology) n
LEFT JOIN (SELECT term, count(DISTINCT gene) AS n FROM b GROUP BY term) c ON c.term = n.node""")
def term_sizes(t: Tables) -> DataFrame:
    return O.term_sizes(t.ontology, t.known_genes)


@query("SELECT DISTINCT o.parent AS term, o.child AS gene FROM ontology o JOIN known_genes k ON k.node = o.child")
def direct_genes(t: Tables) -> DataFrame:
    return O.direct_genes(t.ontology, t.known_genes)


@query("""
WITH RECURSIVE l AS (
  SELECT DISTINCT child AS node, 0 AS layer FROM ontology WHERE child NOT IN (SELECT parent FROM ontology)
  UNION SELECT o.parent, l.layer + 1 FROM l JOIN ontology o ON o.child = l.node)
SELECT node, max(layer) AS layer FROM l GROUP BY node""")
def ontology_layers(t: Tables) -> DataFrame:
    return O.ontology_layers(t.ontology).select("node", "layer")
